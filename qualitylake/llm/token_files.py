"""Token ids as binary shards: one zstandard frame per document under a shared dictionary.

A shard is one binary value: a header, an index with each document's frame offset, and the frames.

    header   magic "QLT1", id width in bytes (1 byte), documents (uint32), sha-256 of the dictionary (32 bytes)
    index    documents + 1 frame offsets (uint64, from the end of the index), then documents token counts (uint64)
    frames   per document one zstandard frame of its ids, little-endian unsigned

The dictionary is trained on the serialized ids of a bounded sample and lies beside the shards, named by its
hash, so a short document is read by its offset alone. Shards are Parquet values, which any store of Spark's
takes, in ascending order of doc_id (null first, then by a hash of the text, equal rows in any order); `start` is a shard's first token
among all tokens of the table.

Null and empty texts have the end id only. Repeated rows are kept one by one. Very long texts are one frame. An
empty table gives an empty set of shards. Columns other than doc_id and text play no part."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import runs, shared_dir
from .encoding import word_encoder

MAGIC = b"QLT1"
#: doc_ids: in text, which keeps large ids exact beside nulls; `before`: the tokens of the same part in earlier shards.
SHARD = "part int, shard int, doc_ids array<string>, before long, n_tokens long, data binary"
_HEAD = struct.Struct("<4sBI32s")


def pack_shard(ids: list[bytes], width: int, dictionary: bytes, compress) -> bytes:
    frames = [compress(x) for x in ids]
    offsets = np.cumsum([0, *map(len, frames)]).astype("<u8")
    counts = np.array([len(x) // width for x in ids], "<u8")
    return b"".join([_HEAD.pack(MAGIC, width, len(ids), hashlib.sha256(dictionary).digest()), offsets.tobytes(), counts.tobytes(), *frames])


class Shard:
    """Reads documents of a shard by place, each by itself."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, self.width, self.n, digest = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        index = np.frombuffer(data, "<u8", 2 * self.n + 1, _HEAD.size)
        self.offsets, self.counts = index[: self.n + 1], index[self.n + 1 :]
        self.data, self.base = memoryview(data), _HEAD.size + index.nbytes
        self.decompress = _decompressor(dictionary).decompress

    def ids(self, i: int) -> np.ndarray:
        frame = self.data[self.base + int(self.offsets[i]) : self.base + int(self.offsets[i + 1])]
        raw = self.decompress(frame, max_output_size=int(self.counts[i]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}")


@lru_cache(maxsize=4)
def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def train_dictionary(docs: DataFrame, tokenizer: str, size: int = 1 << 16, sample: int = 1000, chars: int = 4000) -> bytes:
    """A dictionary from about `sample` documents chosen by a hash of their id, `chars` characters of each."""
    n = docs.count()
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // sample))) == 0)
    texts = [r[0] for r in chosen.select(F.substring("text", 1, chars)).where("text is not null").limit(2 * sample).collect()]
    encoder = word_encoder(tokenizer)
    samples = [x for x in encoder.encode(texts) if x]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        return b""


def write_token_files(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, level: int = 3, shard_docs: int = 512, shard_bytes: int = 4 << 20, path: str | None = None) -> str:
    """Encode whole texts, append the end id, and write the shards; returns their folder."""
    spark = docs.sparkSession
    path = path or shared_dir(spark, "tokens")
    dictionary = train_dictionary(docs, tokenizer)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), dictionary, tokenizer, end_id)], "sha256 string, dictionary binary, tokenizer string, end_id int").write.parquet(f"{path}/dictionary")
    ranged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("_h"), F.rand(7).alias("_salt")).repartitionByRange("doc_id", "_h", "_salt").sortWithinPartitions("doc_id", "_h", "_salt").select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("string").alias("doc_id"), "text")

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = word_encoder(tokenizer)
        width = encoder.dtype.itemsize
        end = np.array([end_id], encoder.dtype).tobytes()
        packer = zstandard.ZstdCompressor(level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        number = before = 0
        for b in batches:
            texts, names, part = b.text.tolist(), b.doc_id.tolist(), int(b.part.iloc[0])
            for at, to in runs(texts, shard_docs, shard_bytes):
                ids = [x + end for x in encoder.encode(texts[at:to])]
                doc_ids = names[at:to]
                yield pd.DataFrame({"part": [part], "shard": [number], "doc_ids": [doc_ids], "before": [before], "n_tokens": [n := sum(map(len, ids)) // width], "data": [pack_shard(ids, width, dictionary, packer.compress)]})
                number, before = number + 1, before + n

    ranged.mapInPandas(shards, SHARD).write.option("compression", "none").parquet(f"{path}/shards")
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files at `path`."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    shards = spark.read.schema(SHARD).parquet(f"{path}/shards")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = shards.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("before"))  # one row per written part

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for names, start, data in zip(b.doc_ids, b.start, b["data"]):
                shard = Shard(bytes(data), dictionary)
                counts = shard.counts.astype("i8")
                crcs = [zlib.crc32(shard.ids(i).astype("<u4").tobytes()) for i in range(shard.n)]
                yield pd.DataFrame({"doc_id": list(names), "start": int(start) + np.cumsum(counts) - counts, "n_tokens": counts, "ids_crc32": np.array(crcs, "i8")})

    return placed.mapInPandas(documents, "doc_id string, start long, n_tokens long, ids_crc32 long").withColumn("doc_id", F.col("doc_id").cast("long"))


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of a few documents, each decompressed by its offset alone."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    wanted = {str(x) for x in doc_ids}
    shards = spark.read.parquet(f"{path}/shards").where(F.arrays_overlap("doc_ids", F.array(*[F.lit(x) for x in wanted])))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for names, data in zip(b.doc_ids, b["data"]):
                shard = Shard(bytes(data), dictionary)
                hits = [i for i, x in enumerate(names) if x in wanted]
                yield pd.DataFrame({"doc_id": [int(names[i]) for i in hits], "ids": [shard.ids(i).astype("i8").tolist() for i in hits]})

    return shards.select("doc_ids", "data").mapInPandas(pick, "doc_id long, ids array<long>")
