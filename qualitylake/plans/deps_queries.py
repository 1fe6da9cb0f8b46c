"""Queries over imports and packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import deps as ops
from .adapters import view

LOCAL = "(SELECT DISTINCT repo, module FROM v_imports WHERE line = 7)"
CLASSES = f"""SELECT i.repo, i.file, i.module, i.line, CASE WHEN n.module IS NOT NULL OR x.state = 'present' THEN 'undeclared' WHEN x.state = 'absent' THEN 'hallucinated' ELSE 'unresolved' END AS kind,
  coalesce(n.distribution, CASE WHEN x.state = 'present' THEN x.distribution END) AS distribution
  FROM v_imports i LEFT JOIN (SELECT repo, module, min(distribution) AS distribution FROM v_installed GROUP BY repo, module) n ON n.repo = i.repo AND n.module = i.module LEFT JOIN v_index x ON x.module = i.module
  WHERE NOT EXISTS (SELECT 1 FROM v_declared d WHERE d.repo = i.repo AND d.module = i.module) AND NOT starts_with(i.module, 'p1') AND NOT EXISTS (SELECT 1 FROM {LOCAL} l WHERE l.repo = i.repo AND l.module = i.module)"""
USED = "v_imports v_declared v_installed v_index"


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, declared, installed, index = (view(spark, sf_dir, n) for n in USED.split())
    stdlib = i.select("module").distinct().where(F.col("module").startswith("p1"))
    return ops.classify_imports(i, stdlib, declared, i.where("line = 7").select("repo", "module").distinct(), installed, index)


@query(CLASSES, USED)
def classify_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir)


@query(f"SELECT repo, {', '.join(f'count(CASE WHEN kind = {chr(39)}{k}{chr(39)} THEN 1 END) AS {k}' for k in ('undeclared', 'hallucinated', 'unresolved'))} FROM ({CLASSES}) GROUP BY repo", USED)
def sca_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sca_counts(_classified(spark, sf_dir))


@query(
    f"""SELECT repo, CASE kind WHEN 'undeclared' THEN 'sca.undeclared_dependency' WHEN 'hallucinated' THEN 'sca.hallucinated_import' ELSE 'sca.unresolved_import' END AS rule, 'sca' AS engine, CASE kind WHEN 'hallucinated' THEN 'error' ELSE 'warning' END AS severity,
    file, line AS start_line, module AS symbol, CASE kind WHEN 'hallucinated' THEN 'no package named `' || module || '` exists' ELSE '`' || module || '` is imported but not declared' END AS message FROM ({CLASSES})""",
    USED,
)
def sca_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sca_findings(_classified(spark, sf_dir))


@query(
    f"""SELECT i.repo, i.file, i.module, i.line FROM v_imports i WHERE NOT EXISTS (SELECT 1 FROM {LOCAL} l WHERE l.repo = i.repo AND l.module = i.module)
    AND NOT (EXISTS (SELECT 1 FROM v_declared d WHERE d.repo = i.repo AND d.module = i.module) AND CAST(substr(i.repo, 2) AS INT) % 2 = 0)""",
    "v_imports v_declared",
)
def undeclared_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even repositories declare at their root and again, with nothing of use, in `src`; odd ones only there."""
    i = view(spark, sf_dir, "v_imports")
    repos = i.select("repo").distinct()
    even = F.regexp_extract("repo", "([0-9]+)", 1).cast("int") % 2 == 0
    named = view(spark, sf_dir, "v_declared").select("repo", F.when(even, "src").otherwise("docs").alias("dir"), "module")
    declared = named.unionByName(repos.select("repo", F.lit(".").alias("dir"), F.lit("nothing").alias("module")))
    return ops.undeclared_imports(i, declared, i.where("line = 7").select("repo", "module").distinct())


@query(
    """SELECT DISTINCT repo, CASE WHEN contains(rel, '/') THEN split_part(rel, '/', 1) ELSE regexp_replace(rel, '\\.py$', '') END AS module FROM (
    SELECT repo, path AS rel FROM v_paths WHERE ends_with(path, '.py') UNION ALL SELECT repo, substr(path, 5) FROM v_paths WHERE ends_with(path, '.py') AND starts_with(path, 'src/')
    UNION ALL SELECT repo, substr(path, 7) FROM v_paths WHERE ends_with(path, '.py') AND starts_with(path, 'tests/'))""",
    "v_paths",
)
def local_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.local_modules(view(spark, sf_dir, "v_paths"))
