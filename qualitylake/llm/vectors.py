"""Vectors as rows: which take part, how they are packed, and how queries meet blocks of data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usable(vectors: DataFrame, zero: bool = True, beside: str | None = None) -> tuple[DataFrame, int]:
    """vec_id and embedding of the vectors that take part, one row per id, and their dimension.

    Null ids, null and empty vectors, vectors that hold a null or non-finite component and, if asked, zero vectors
    take no part. The dimension is the longest vector's; a shorter one counts as if zeros followed. Where an id
    repeats, its smallest vector stands for it. A column `beside` the vector goes with it, the smallest of equal vectors'."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = vectors.where(F.col("vec_id").isNotNull() & e.isNotNull()).where(fine & (F.size(e) > 0))
    if not zero:
        whole = whole.where(F.exists(e, lambda x: x != 0))
    dim = whole.agg(F.max(F.size(e))).first()[0] or 0
    wide = F.when(F.size(e) == dim, e).otherwise(F.concat(e, F.array_repeat(F.lit(0.0).cast(vectors.schema["embedding"].dataType.elementType), F.lit(dim) - F.size(e))))
    if beside:
        whole = whole.groupBy("vec_id").agg(F.min(F.struct("embedding", beside)).alias("least")).select("vec_id", "least.*")
        return whole.select("vec_id", wide.alias("embedding"), beside), dim
    return whole.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select("vec_id", wide.alias("embedding")), dim


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    """A column of arrays as rows of doubles."""
    return np.array(column.tolist(), float).reshape(-1, dim)


def pack_rows(rows: np.ndarray) -> list[bytes]:
    """Each row as little-endian bytes: two per whole number where they all fit, else eight. Beyond 2^62 numbers end."""
    rows = np.clip(rows, -(2.0**62), 2.0**62)
    small = (np.abs(rows) < 1 << 15).all(axis=1)
    return [(r.astype("<i2") if s else r.astype("<i8")).tobytes() for r, s in zip(rows, small)]


def unpack_rows(packed: list[bytes], dim: int) -> np.ndarray:
    if len({len(p) for p in packed}) == 1:
        return np.frombuffer(b"".join(packed), "<i2" if len(packed[0]) == 2 * dim else "<i8").reshape(-1, dim).astype(np.int64)
    return np.array([np.frombuffer(p, "<i2" if len(p) == 2 * dim else "<i8").astype(np.int64) for p in packed]).reshape(-1, dim)


def hash_sample(rows: DataFrame, n: int, size: int) -> list[Row]:
    """The `size` of `n` rows whose ids hash lowest. Tasks order only rows below a hash that some four times as many lie
    under, so what they send to the driver doesn't grow with their number."""
    key = F.xxhash64("vec_id")
    if n > 4 * size:
        few = rows.where(key < F.lit(-(2**63) + 2**64 * 4 * size // n)).orderBy(key).limit(size).collect()
        if len(few) == size:
            return few
    return rows.orderBy(key).limit(size).collect()


def blocks_a_part(total: int) -> int:
    """How many blocks stand under one key for queries to meet: one where all blocks are few, so that every task has
    some, else up to eight, as queries travel once a key."""
    return min(8, max(1, total // 64))


def dealt(packed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by keys over all shuffle partitions: they are few bytes for the work that is done on them, and Spark
    would else put them in a few tasks."""
    return packed.repartition(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def met(sent: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Packed queries beside the blocks of their key. Spark takes what a grouped map or an explode makes for as large as
    what it reads, and would broadcast all packed queries through the driver; so a sort-merge join is asked for."""
    return dealt(sent, keys).hint("merge").join(dealt(blocks, keys), keys)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id; -inf scores are none."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    at = at[np.lexsort((ids[at], -scores[at]))][:k]
    return at[scores[at] > -np.inf]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best among what the blocks found."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
