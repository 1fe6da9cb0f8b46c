"""Queries over baselines and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scoring
from ..operators import findings as fops
from ..operators import history as ops
from .adapters import view
from .findings_queries import FINGERPRINT, SCORES

SPLIT = "2024-01-15"
BASE = f"(SELECT DISTINCT repo, {FINGERPRINT} AS fp FROM v_findings WHERE run_id < '{SPLIT}')"
PRINTS = f"(SELECT *, {FINGERPRINT} AS fp FROM v_findings)"


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = view(spark, sf_dir, "v_findings")
    return f, ops.baseline_of(f.where(F.col("run_id") < SPLIT))


@query(f"SELECT repo, fp AS fingerprint FROM {BASE}", "v_findings")
def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir)[1]


@query(
    f"""SELECT n.repo, n.run_id, n.new, s.size - n.kept AS resolved FROM (SELECT f.repo, f.run_id, count(CASE WHEN b.fp IS NULL THEN 1 END) AS new, count(DISTINCT b.fp) AS kept FROM {PRINTS} f LEFT JOIN {BASE} b ON b.repo = f.repo AND b.fp = f.fp GROUP BY f.repo, f.run_id) n
    JOIN (SELECT repo, count(*) AS size FROM {BASE} GROUP BY repo) s ON s.repo = n.repo""",
    "v_findings",
)
def compare_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.compare_baseline(*_split(spark, sf_dir))


@query(f"SELECT f.repo, f.id, f.fp AS fingerprint FROM {PRINTS} f WHERE NOT EXISTS (SELECT 1 FROM {BASE} b WHERE b.repo = f.repo AND b.fp = f.fp)", "v_findings")
def new_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.new_findings(*_split(spark, sf_dir)).select("repo", "id", "fingerprint")


@query(
    f"""SELECT g.repo, g.run_id, g.id, g.reason FROM v_gates g LEFT JOIN (SELECT f.repo, f.run_id, f.engine, bool_or(b.fp IS NULL) AS any_new FROM {PRINTS} f LEFT JOIN {BASE} b ON b.repo = f.repo AND b.fp = f.fp GROUP BY f.repo, f.run_id, f.engine) n
    ON n.repo = g.repo AND n.run_id = g.run_id AND n.engine = g.id WHERE g.enforced AND NOT g.pass AND coalesce(any_new, true)""",
    "v_gates",
)
def gates_failing_on_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, b = _split(spark, sf_dir)
    return ops.gates_failing_on_new(view(spark, sf_dir, "v_gates"), f, b)


NAMES = ["correctness", "efficiency", "security", "a11y", "maintainability"]


@query(
    f"""SELECT r.repo, r.run_id, concat_ws(',', {', '.join(f"CASE WHEN r.{n} <> r.was_{n} THEN '{n}' END" for n in NAMES)}) AS changed,
      (SELECT count(*) FROM (SELECT DISTINCT fp FROM {PRINTS} a WHERE a.repo = r.repo AND a.run_id = r.run_id AND NOT EXISTS (SELECT 1 FROM {PRINTS} b WHERE b.repo = a.repo AND b.fp = a.fp AND b.run_id = r.was_run))) AS new,
      (SELECT count(*) FROM (SELECT DISTINCT fp FROM {PRINTS} a WHERE a.repo = r.repo AND a.run_id = r.was_run AND NOT EXISTS (SELECT 1 FROM {PRINTS} b WHERE b.repo = a.repo AND b.fp = a.fp AND b.run_id = r.run_id))) AS resolved
    FROM (SELECT *, lag(run_id) OVER w AS was_run, {', '.join(f'lag({n}) OVER w AS was_{n}' for n in NAMES)} FROM ({SCORES}) WINDOW w AS (PARTITION BY repo ORDER BY run_id)) r WHERE was_run IS NOT NULL""",
    "v_findings",
)
def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "v_findings")
    return ops.trend(fops.scores(f, f), f, NAMES)


@query(f"SELECT DISTINCT repo, fp AS fingerprint FROM {PRINTS} WHERE run_id >= '{SPLIT}' EXCEPT SELECT repo, fp FROM {BASE}", "v_findings")
def fingerprint_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, b = _split(spark, sf_dir)
    return ops.fingerprint_difference(f.where(F.col("run_id") >= SPLIT).withColumn("fingerprint", scoring.fingerprint()), b)
