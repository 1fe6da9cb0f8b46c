"""Findings over time: baselines and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring
from .findings import RUN, _engine_of_gate

BASELINE_VERSION = 1


def baseline_of(findings: DataFrame) -> DataFrame:
    """repo and fingerprint of findings, once each."""
    return findings.select("repo", scoring.fingerprint().alias("fingerprint")).distinct()


def write_baseline(findings: DataFrame, path: str) -> None:
    baseline_of(findings).withColumn("version", F.lit(BASELINE_VERSION)).write.mode("overwrite").parquet(path)


def read_baseline(spark, path: str) -> DataFrame:
    """A written baseline; another version than this one fails the read."""
    df = spark.read.parquet(path)
    check = F.when(F.col("version") == BASELINE_VERSION, F.col("fingerprint")).otherwise(F.raise_error(F.concat(F.lit("unsupported baseline version "), F.col("version").cast("string"))))
    return df.select("repo", check.alias("fingerprint"))


def compare_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per run: findings whose fingerprint is not in the repo's baseline, and baseline entries no longer found."""
    f = findings.select(*RUN, scoring.fingerprint().alias("fingerprint"))
    b = baseline.select("repo", "fingerprint").distinct().withColumn("_known", F.lit(True))
    marked = f.join(b, ["repo", "fingerprint"], "left")
    new = marked.groupBy(*RUN).agg(F.count_if(F.col("_known").isNull()).alias("new"), F.count_distinct(F.when(F.col("_known"), F.col("fingerprint"))).alias("_kept"))
    sizes = b.groupBy("repo").agg(F.count("*").alias("_size"))
    return new.join(sizes, "repo", "left").select(*RUN, "new", (F.coalesce("_size", F.lit(0)) - F.col("_kept")).alias("resolved"))


def new_findings(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", scoring.fingerprint()).join(baseline, ["repo", "fingerprint"], "left_anti")


def gates_failing_on_new(gates: DataFrame, findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Failed and enforced gates with at least one new finding of their own, or with no findings of their own."""
    b = baseline.select("repo", "fingerprint").distinct().withColumn("_known", F.lit(True))
    f = findings.select(*RUN, "engine", scoring.fingerprint().alias("fingerprint")).join(b, ["repo", "fingerprint"], "left")
    per = f.groupBy(*RUN, "engine").agg(F.bool_or(F.col("_known").isNull()).alias("any_new"))
    failed = gates.where("enforced and not pass").withColumn("engine", _engine_of_gate())
    return failed.join(per, [*RUN, "engine"], "left").where(F.coalesce("any_new", F.lit(True))).select(*RUN, "id", "reason")


def trend(scores: DataFrame, findings: DataFrame, names: list[str]) -> DataFrame:
    """Each run against the run before it in the same repo: changed scores, new and resolved fingerprints.

    scores: repo, run_id and the named scores; runs are ordered by run_id. First runs have no row. The runs that have
    a fingerprint are islands in the order of runs: it is new where one begins, and resolved in the run behind its end."""
    w = Window.partitionBy("repo").orderBy("run_id")
    runs = scores.select("repo", "run_id", F.row_number().over(w).alias("n"), *names, *[F.lag(s).over(w).alias(f"_was_{s}") for s in names])
    changed = F.array_join(F.filter(F.array(*[F.when(F.col(s) != F.col(f"_was_{s}"), F.lit(s)) for s in names]), lambda x: x.isNotNull()), ",")
    prints = findings.select("repo", "run_id", scoring.fingerprint().alias("fp")).join(runs.select("repo", "run_id", "n"), ["repo", "run_id"])
    # equal ones of a run first, so a frequent fingerprint is a row a run before runs meet
    island = Window.partitionBy("repo", "fp").orderBy("n")
    held = prints.select("repo", "fp", "n").distinct().withColumns({"came": F.coalesce(F.lag("n").over(island) < F.col("n") - 1, F.lit(True)), "went": F.coalesce(F.lead("n").over(island) > F.col("n") + 1, F.lit(True))})
    came, went = F.when(F.col("came"), F.struct("n", F.lit(True).alias("is_new"))), F.when(F.col("went"), F.struct((F.col("n") + 1).alias("n"), F.lit(False).alias("is_new")))
    moves = held.where("came or went").select("repo", F.inline(F.filter(F.array(came, went), lambda x: x.isNotNull())))
    moved = moves.groupBy("repo", "n").agg(F.count_if("is_new").alias("new"), F.count_if(~F.col("is_new")).alias("resolved"))
    out = runs.where("n > 1").join(moved, ["repo", "n"], "left")
    return out.select("repo", "run_id", changed.alias("changed"), F.coalesce("new", F.lit(0)).alias("new"), F.coalesce("resolved", F.lit(0)).alias("resolved"))


def fingerprint_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Fingerprints of a that b lacks."""
    return a.select("repo", "fingerprint").subtract(b.select("repo", "fingerprint"))
