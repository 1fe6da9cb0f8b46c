"""Quality scores by compression under dictionaries of good and bad text.

Two zstandard dictionaries hold slices of labelled good and bad texts. A text is compressed under each; the
difference of the two sizes per byte is its evidence, beside the log of their ratio. The size per byte without a
dictionary calibrates them, as it tells repetition from likeness. A logistic curve fitted on labelled texts that are in neither dictionary turns these into the
probability of label 1.

The classifier is fitted on a sample of labelled rows of bounded size (`per_class` rows of each label, chosen by
a hash of doc_id, `chars` characters of each, spread over the whole text); scores read whole texts. Rows whose label or id is null teach
nothing; repeated labels count once, and of the texts of a repeated doc_id the smallest teaches. Null texts score as empty ones. Where one label is
missing, every score is the share of label 1, or 0.5 without labels. Other columns play no part; an empty table
gives an empty table."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str | Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the number of folds; fold 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries, the logistic curve over scaled evidence, and the share of label 1."""

    good: bytes
    bad: bytes
    center: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    prior: float
    level: int = 6

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.prior)
        x = (evidence(texts, self.good, self.bad, self.level) - self.center) / self.scale
        return logistic(x @ self.weights[:-1] + self.weights[-1])


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    return zstandard.ZstdCompressor(level, dict_data=data, write_content_size=False)


def evidence(texts: list[str], good: bytes, bad: bytes, level: int) -> np.ndarray:
    g, b, plain = _compressor(good, level), _compressor(bad, level), _compressor(b"", 1)
    data = (t.encode("utf-8", "replace") for t in texts)  # one at a time
    sizes = np.array([[len(g.compress(d)), len(b.compress(d)), len(plain.compress(d)), len(d) + 16] for d in data], float).reshape(-1, 4)
    return np.stack([(sizes[:, 1] - sizes[:, 0]) / sizes[:, 3], np.log(sizes[:, 1] / sizes[:, 0]), sizes[:, 2] / sizes[:, 3]], axis=1)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_curve(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weighted logistic regression by Newton steps, with a small ridge."""
    x = np.c_[x, np.ones(len(x))]
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = logistic(x @ beta)
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (w * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _slices(texts: list[tuple[int, str]], size: int, each: int = 400) -> bytes:
    """About `size` bytes of slices, from places that a hash of the id picks; again from the first text while there is room."""
    out, total = [], 0
    for turn in range(4):
        for i, t in texts:
            at = zlib.crc32(f"{i}/{turn}".encode()) % max(1, len(t) - each)
            out.append(t[at : at + each].encode("utf-8", "replace") + b"\n")
            total += len(out[-1])
            if total >= size:
                return b"".join(out)[:size]
    return b"".join(out)


def spread(text: Column, chars: int, n: int = 8) -> Column:
    """`n` slices of a longer text, evenly from its first to its last character, `chars` characters in all."""
    each = chars // n
    cuts = [F.substring(text, F.floor((F.length(text) - each) * i / (n - 1)).cast("int") + 1, F.lit(each)) for i in range(n)]
    return F.when(F.length(text) <= chars, text).otherwise(F.concat(*cuts))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, chars: int = 20_000, dictionary: int = 800_000) -> QualityModel:
    """A model from labelled documents outside fold 0."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(fold("doc_id") != 0).select("doc_id", "quality").distinct()
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return QualityModel(b"", b"", (), (), (), prior)
    keep = F.lit(False)
    for q, n in counts.items():
        keep = keep | ((F.col("quality") == q) & (F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, per_class / n))))
    # the sample is bounded: about per_class rows of either label
    sample = known.where(keep).withColumnRenamed("doc_id", "_id")
    met = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    rows = met.groupBy("doc_id", "quality").agg(F.min(spread(F.coalesce("text", F.lit("")), chars)).alias("text")).collect()  # one row per sampled label
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode() + b"o"), r["text"]))
    part = {(q, h): [(r["doc_id"], r["text"]) for k, r in enumerate(x for x in rows if x["quality"] == q) if k % 2 == h] for q in (0, 1) for h in (0, 1)}
    if not (part[0, 0] and part[1, 0] and part[0, 1] and part[1, 1]):
        return QualityModel(b"", b"", (), (), (), prior)
    good, bad = _slices(part[1, 0], dictionary), _slices(part[0, 0], dictionary)
    x = evidence([t for q in (0, 1) for _, t in part[q, 1]], good, bad, QualityModel.level)
    y = np.repeat([0.0, 1.0], [len(part[0, 1]), len(part[1, 1])])
    w = np.where(y == 1, prior / len(part[1, 1]), (1 - prior) / len(part[0, 1])) * len(y)
    center, scale = x.mean(0), x.std(0) + 1e-9
    beta = fit_curve((x - center) / scale, y, w)
    return QualityModel(good, bad, tuple(center), tuple(scale), tuple(beta), prior)


def with_score(docs: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """Add the probability that a whole text is good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score([t or "" for t in texts]), dtype="float64")

    return docs.withColumn(name, score(F.col("text")))


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that are not rejected, as they are."""
    names = docs.columns
    scored = with_score(docs.select(F.struct(*names).alias("_row"), "text"), fit(docs, labels), "_score")
    return scored.where(F.col("_score") >= threshold).select("_row.*")
