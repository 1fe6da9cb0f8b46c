"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Where a local session has no such setting one is made for it; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="qualitylake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/qualitylake/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a frame to the shared folder and read it again: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_checked(left: DataFrame, right: DataFrame, on: Column | str | list[str], rows: int, how: str = "inner", limit: int = 100_000) -> DataFrame:
    """Join to a side of `rows` rows: broadcast up to `limit` of them, else a shuffled join that AQE can split."""
    return left.join(F.broadcast(right) if rows <= limit else right, on, how)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


_HELD: dict[tuple, object] = {}


def one_per_worker(key: tuple, make: Callable[[], T]) -> T:
    """What `make` builds for a key, kept for this Python worker's next batches. Only the last key's is kept:
    workers serve one stage after another, and each stage's tables should not outlive it."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def runs(texts: list[str], count: int = 256, chars: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Starts and ends of runs of texts, of at most `count` texts and, but for single ones, `chars` characters."""
    at = 0
    while at < len(texts):
        to, n = at + 1, len(texts[at])
        while to < len(texts) and to - at < count and n + len(texts[to]) <= chars:
            n += len(texts[to])
            to += 1
        yield at, to
        at = to


def tokenizer_path(name: str) -> str:
    """A vocabulary file: a path as it stands, or a bare name among the installed public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
