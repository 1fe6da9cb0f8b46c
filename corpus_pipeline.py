"""A training corpus from documents, in five stages; each stage's table is written and read by the next.

quality      documents that the compression classifier rejects go
near_dups    of each group of near copies (five-word shingles, similarity 0.8) one document stays
secrets      secret values in the texts are replaced by a mark; no document goes
mix          documents are repeated or left out until sources meet their target weights
pack         texts become token pieces, each with its place in a sequence of at most 4096 tokens"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qualitylake.llm import mixing, near_dup, packing, quality, secret_scan
from qualitylake.llm.common import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 and more. Null texts score as empty ones; repeated rows and null ids are each scored
    for themselves; without labels nothing goes; an empty table gives an empty one."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group. Null and empty texts and null ids stay; of rows equal in id and text one stays; an
    empty table gives an empty one."""
    return near_dup.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts marked; null and empty texts as they are; an empty table gives an empty one."""
    return secret_scan.redact(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them. Null sources are one source; null and empty texts have no words and stay
    or go with their source's draws; rows equal in source, id and text share a draw; an empty table gives an empty one."""
    return mixing.mix(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, repeated ones each for itself; null and empty texts are their end id; an empty table gives
    no pieces."""
    return packing.pack(docs, kept=300_000)  # executors still hold memory of the stages before


STAGES = [
    ("quality", quality_stage),
    ("near_dups", near_dup_stage),
    ("secrets", secret_stage),
    ("mix", mix_stage),
    ("pack", pack_stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
