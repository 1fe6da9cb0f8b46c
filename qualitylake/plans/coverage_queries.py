"""Queries over functions and coverage lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import coverage as ops
from .adapters import view

OWNED = "(SELECT c.repo, f.file, c.line, c.hits FROM v_cov_lines c JOIN (SELECT DISTINCT repo, file FROM v_functions) f ON c.repo = f.repo AND c.report_path = '/ci/build/' || f.file)"
COV = f"(SELECT f.repo, f.file, f.symbol, count(CASE WHEN hits > 0 THEN 1 END) AS covered, count(*) AS lines, count(CASE WHEN hits > 0 THEN 1 END) / count(*)::DOUBLE AS coverage FROM v_functions f JOIN {OWNED} c ON c.repo = f.repo AND c.file = f.file AND c.line BETWEEN f.start_line AND f.end_line GROUP BY f.repo, f.file, f.symbol)"
SCORED = f"(SELECT f.*, c.coverage, cc * cc * pow(1 - coverage, 3) + cc AS crap FROM v_functions f JOIN {COV} c ON c.repo = f.repo AND c.file = f.file AND c.symbol = f.symbol)"
ALL = f"(SELECT f.*, c.coverage, cc * cc * pow(1 - coverage, 3) + cc AS crap FROM v_functions f LEFT JOIN {COV} c ON c.repo = f.repo AND c.file = f.file AND c.symbol = f.symbol)"
USED = "v_functions v_cov_lines"


def _covered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    functions, lines = view(spark, sf_dir, "v_functions"), view(spark, sf_dir, "v_cov_lines")
    owned = lines.join(ops.own_paths(lines, functions), ["repo", "report_path"])
    return functions, ops.function_coverage(functions, owned)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.score_functions(*_covered(spark, sf_dir))


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"SELECT repo, file, symbol, start_line, end_line, cc, round(coverage, 6) AS coverage, round(crap, 6) AS crap, place FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY crap DESC, file, symbol) AS place FROM {SCORED}) WHERE place <= 10", USED)
def worst_crap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ops.worst(_scored(spark, sf_dir)))


@query("SELECT DISTINCT c.repo, c.report_path, f.file FROM v_cov_lines c JOIN v_functions f ON c.repo = f.repo AND (c.report_path = f.file OR ends_with(c.report_path, '/' || f.file))", USED)
def own_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.own_paths(view(spark, sf_dir, "v_cov_lines"), view(spark, sf_dir, "v_functions"))


@query(f"SELECT repo, file, symbol, covered, lines, round(coverage, 6) AS coverage FROM {COV}", USED)
def function_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_covered(spark, sf_dir)[1])


RECORDS = f"(SELECT repo, file, covered % 3 AS prefix, CASE WHEN covered % 2 = 0 THEN 'crate::' || symbol ELSE symbol END AS name, coverage FROM {COV} UNION ALL SELECT repo, file, 1 AS prefix, symbol AS name, 0.5 AS coverage FROM v_functions WHERE cc % 4 = 0)"


@query(
    f"""SELECT f.repo, f.file, f.symbol, f.cc, round(b.coverage, 6) AS coverage, rank = 0 AS exact FROM v_functions f JOIN (
      SELECT *, row_number() OVER (PARTITION BY repo, file, symbol ORDER BY prefix, rank, coverage DESC) AS n FROM (
        SELECT repo, file, prefix, name AS symbol, coverage, 0 AS rank FROM {RECORDS} UNION ALL
        SELECT repo, file, prefix, substr(name, 8) AS symbol, coverage, 1 AS rank FROM {RECORDS} WHERE starts_with(name, 'crate::')) r) b
    ON b.repo = f.repo AND b.file = f.file AND b.symbol = f.symbol AND b.n = 1""",
    USED,
)
def match_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions, cov = _covered(spark, sf_dir)
    name = F.when(F.col("covered") % 2 == 0, F.concat(F.lit("crate::"), "symbol")).otherwise(F.col("symbol"))
    records = cov.select("repo", "file", (F.col("covered") % 3).alias("prefix"), name.alias("name"), "coverage")
    more = functions.where("cc % 4 = 0").select("repo", "file", F.lit(1).cast("long").alias("prefix"), F.col("symbol").alias("name"), F.lit(0.5).alias("coverage"))
    return _round(ops.match_symbols(functions, records.unionByName(more)).select("repo", "file", "symbol", "cc", "coverage", "exact"))


@query(f"SELECT repo, file, symbol, cc FROM {ALL} WHERE coverage IS NULL", USED)
def functions_without_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.unmatched(*_covered(spark, sf_dir)).select("repo", "file", "symbol", "cc")


@query(f"SELECT repo, file, symbol, round(crap, 6) AS crap FROM {SCORED} WHERE crap > 30", USED)
def over_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ops.over_threshold(_scored(spark, sf_dir)).select("repo", "file", "symbol", "crap"))


@query(f"SELECT repo, file, symbol, cc FROM {SCORED} WHERE cc >= 5 AND coverage = 0", USED)
def untested_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.untested(_scored(spark, sf_dir)).select("repo", "file", "symbol", "cc")


SUMMARY = f"(SELECT repo, coalesce(max(crap), 0) AS crap_max, count(CASE WHEN crap > 30 THEN 1 END) AS over, count(CASE WHEN cc >= 5 AND coverage = 0 THEN 1 END) AS untested, count(CASE WHEN coverage IS NULL THEN 1 END) AS unmatched, bool_and(coverage IS NOT NULL) AS coverage_complete FROM {ALL} GROUP BY repo)"


@query(f'SELECT repo, round(crap_max, 6) AS crap_max, "over", untested, unmatched, coverage_complete FROM {SUMMARY.replace("AS over", chr(65) + "S " + chr(34) + "over" + chr(34))}', USED)
def crap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ops.crap_summary(*_covered(spark, sf_dir)))


@query(
    f"""SELECT repo, 'crap' AS id, o = 0 AND untested = 0 AND coverage_complete AS pass, o > 0 OR untested > 0 OR coverage_complete AS enforced,
    CASE WHEN o > 0 OR untested > 0 THEN concat_ws(', ', CASE WHEN o > 0 THEN o || CASE WHEN o = 1 THEN ' function' ELSE ' functions' END || ' over the threshold' END, CASE WHEN untested > 0 THEN untested || CASE WHEN untested = 1 THEN ' complex function' ELSE ' complex functions' END || ' untested' END)
    || CASE WHEN coverage_complete THEN '' ELSE '; ' || unmatched || CASE WHEN unmatched = 1 THEN ' function' ELSE ' functions' END || ' without coverage' END
    WHEN NOT coverage_complete THEN unmatched || CASE WHEN unmatched = 1 THEN ' function' ELSE ' functions' END || ' without coverage' END AS reason FROM {SUMMARY.replace("AS over", "AS o")}""",
    USED,
)
def crap_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.crap_gate(ops.crap_summary(*_covered(spark, sf_dir)))


@query(f"SELECT repo, rule, severity, total, total || ' functions have no coverage record' AS message, functions FROM (SELECT repo, 'coverage.unmatched' AS rule, 'warning' AS severity, count(*) AS total, string_agg(CASE WHEN n <= 20 THEN file || '::' || symbol END, ', ' ORDER BY n) AS functions FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file, symbol, start_line) AS n FROM {ALL} WHERE coverage IS NULL) GROUP BY repo)", USED)
def unmatched_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.unmatched_finding(ops.unmatched(*_covered(spark, sf_dir)))


@query(f"SELECT repo, round(avg(coverage), 6) AS function_rate, round(sum(covered) / sum(lines)::DOUBLE, 6) AS line_rate FROM {COV} GROUP BY repo", USED)
def line_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ops.line_rate(_covered(spark, sf_dir)[1]))


FILES = "(SELECT repo, file AS path, CAST(max(end_line) AS BIGINT) AS loc FROM v_functions GROUP BY repo, file)"
METRICS = f"(SELECT a.repo, a.files, a.loc, b.functions, b.coverage_changed FROM (SELECT repo, count(*) AS files, sum(loc) AS loc FROM {FILES} GROUP BY repo) a JOIN (SELECT repo, count(*) AS functions, avg(coverage) AS coverage_changed FROM {ALL} GROUP BY repo) b ON a.repo = b.repo)"


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions, cov = _covered(spark, sf_dir)
    files = functions.groupBy("repo", F.col("file").alias("path")).agg(F.max("end_line").cast("long").alias("loc"))
    return ops.scope_metrics(files, functions, cov)


@query(f"SELECT repo, files, CAST(loc AS BIGINT) AS loc, functions, round(coverage_changed, 6) AS coverage_changed FROM {METRICS}", USED)
def scope_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_metrics(spark, sf_dir))


@query(f"SELECT 'fleet' AS repo, CAST(sum(files) AS BIGINT) AS files, CAST(sum(loc) AS BIGINT) AS loc, CAST(sum(functions) AS BIGINT) AS functions, round(sum(coverage_changed), 6) AS coverage_changed, round(max(crap_max), 6) AS crap_max FROM {METRICS} m JOIN (SELECT repo, max(crap) AS crap_max FROM {ALL} GROUP BY repo) s ON m.repo = s.repo", USED)
def merged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = ops.crap_summary(*_covered(spark, sf_dir)).select("repo", "crap_max")
    return _round(ops.merge_metrics(_metrics(spark, sf_dir).join(summary, "repo").withColumn("repo", F.lit("fleet"))))


@query("SELECT DISTINCT repo, CASE WHEN contains(file, '/') THEN regexp_replace(file, '/[^/]*$', '') ELSE '.' END AS dir FROM v_functions", "v_functions")
def source_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.source_dirs(view(spark, sf_dir, "v_functions"))


@query("SELECT repo, count(CASE WHEN lower(summary) = 'caughtmutant' THEN 1 END) AS killed, count(CASE WHEN lower(summary) = 'missedmutant' THEN 1 END) AS survived, count(CASE WHEN lower(summary) = 'timeout' THEN 1 END) AS timeout, 0::BIGINT AS unviable, round(count(CASE WHEN lower(summary) = 'caughtmutant' THEN 1 END) / count(*)::DOUBLE, 6) AS score FROM v_mutants GROUP BY repo", "v_mutants")
def mutation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ops.mutation_summary(view(spark, sf_dir, "v_mutants")))


@query("SELECT repo, 'mutation.survived' AS rule, 'warning' AS severity, file, pos FROM v_mutants WHERE summary = 'MissedMutant'", "v_mutants")
def surviving_mutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.survivor_findings(view(spark, sf_dir, "v_mutants"))


CRAP_ROW = "repo, {rule} AS rule, 'crap' AS engine, 'error' AS severity, file, start_line, symbol, {message} AS message"


@query(
    "SELECT "
    + CRAP_ROW.format(rule="'crap.over_threshold'", message="'CRAP ' || CAST(floor(crap + 0.5) AS BIGINT) || ' (CC=' || cc || ', cov=' || CAST(floor(coverage * 100 + 0.5) AS BIGINT) || '%) exceeds threshold 30'")
    + f" FROM {SCORED} WHERE crap > 30 UNION ALL SELECT "
    + CRAP_ROW.format(rule="'complexity.untested'", message="'CC=' || cc || ' without any covered line'")
    + f" FROM {SCORED} WHERE cc >= 5 AND coverage = 0",
    USED,
)
def crap_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.crap_findings(_scored(spark, sf_dir))


NUMBER = "CAST(substr(f.repo, 2) AS INT)"


@query(
    f"""SELECT repo, 'coverage.missing' AS rule, 'warning' AS severity, CASE WHEN alone AND NOT coalesce(tests_pass, true) THEN 'tests failed: ' || CASE WHEN code IS NOT NULL THEN 'exit code ' || code ELSE coalesce(said, 'no test command was run') END
    ELSE 'no coverage data for ' || n || CASE WHEN n = 1 THEN ' function' ELSE ' functions' END || ': ' || CASE WHEN num % 4 = 0 THEN 'coverage is disabled' WHEN num % 7 = 0 THEN 'no test suite was found' WHEN alone THEN 'no coverage report was written' ELSE 'the report leaves them out' END END AS reason
    FROM (SELECT f.repo, {NUMBER} AS num, count(CASE WHEN f.coverage IS NULL OR {NUMBER} > 8 AND {NUMBER} < 16 THEN 1 END) AS n, bool_and(f.coverage IS NULL OR {NUMBER} > 8 AND {NUMBER} < 16) AS alone FROM {ALL} f GROUP BY f.repo) c
    LEFT JOIN (SELECT repo, bool_and(pass) AS tests_pass, min(reason) AS said FROM v_gates_20 WHERE id = 'tests' GROUP BY repo) t USING (repo)
    LEFT JOIN (SELECT repo, arg_max_null(exit_code, pos) AS code FROM v_runs_20 WHERE engine = 'tests' AND exit_code IS DISTINCT FROM 0 GROUP BY repo) r USING (repo) WHERE n > 0""",
    "v_functions v_cov_lines v_gates_20 v_runs_20",
)
def coverage_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions, cov = _covered(spark, sf_dir)
    n = F.regexp_extract("repo", "([0-9]+)", 1).cast("int")
    repos = functions.select("repo").distinct().select("repo", (n % 4 != 0).alias("coverage_enabled"), (n % 7 != 0).alias("has_suite"))
    return ops.coverage_missing(repos, functions, view(spark, sf_dir, "v_gates_20"), view(spark, sf_dir, "v_runs_20"), cov.where((n <= 8) | (n >= 16)))


@query(
    f"""SELECT repo, 'crap' AS id, o = 0 AND untested = 0 AND coverage_complete AS pass, false AS enforced,
    CASE WHEN o > 0 OR untested > 0 THEN concat_ws(', ', CASE WHEN o > 0 THEN o || CASE WHEN o = 1 THEN ' function' ELSE ' functions' END || ' over the threshold' END, CASE WHEN untested > 0 THEN untested || CASE WHEN untested = 1 THEN ' complex function' ELSE ' complex functions' END || ' untested' END) || ' (advisory)' END AS reason
    FROM (SELECT repo, count(CASE WHEN crap > 30 THEN 1 END) AS o, count(CASE WHEN cc >= 5 AND coverage = 0 THEN 1 END) AS untested, true AS coverage_complete FROM {SCORED} GROUP BY repo)""",
    USED,
)
def crap_gate_advisory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over the functions that have coverage, not enforced."""
    functions, cov = _covered(spark, sf_dir)
    return ops.crap_gate(ops.crap_summary(functions.join(cov.select("repo", "file", "symbol"), ["repo", "file", "symbol"], "left_semi"), cov), enforce=False)


@query(
    """SELECT repo, score, coalesce(findings, 0)::BIGINT AS findings, CASE WHEN ms = 'ran' AND ws = 'ran' THEN 'ran' WHEN ms = 'skipped' AND ws = 'skipped' THEN 'skipped' ELSE 'partial' END AS status
    FROM (SELECT coalesce(m.repo, w.repo) AS repo, score, findings, coalesce(m.status, 'skipped') AS ms, coalesce(w.status, 'skipped') AS ws
    FROM (SELECT repo, round(count(CASE WHEN summary = 'CaughtMutant' THEN 1 END) / count(*)::DOUBLE, 6) AS score, CASE CAST(substr(repo, 2) AS INT) % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'ran' END AS status FROM v_mutants WHERE repo <> 'r7' GROUP BY repo) m
    FULL JOIN (SELECT repo, count(CASE WHEN engine = 'perf' AND CAST(substr(repo, 2) AS INT) % 3 = 0 THEN 1 END) AS findings, CASE CAST(substr(repo, 2) AS INT) % 5 WHEN 0 THEN 'skipped' ELSE 'ran' END AS status FROM v_findings GROUP BY repo) w ON m.repo = w.repo)""",
    "v_mutants v_findings",
)
def test_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_extract("repo", "([0-9]+)", 1).cast("int")
    m = ops.mutation_summary(view(spark, sf_dir, "v_mutants").where("repo <> 'r7'")).select("repo", F.round("score", 6).alias("score"), F.when(n % 4 == 0, "failed").when(n % 4 == 1, "skipped").otherwise("ran").alias("status"))
    w = view(spark, sf_dir, "v_findings").groupBy("repo").agg(F.count_if((F.col("engine") == "perf") & (n % 3 == 0)).alias("findings")).withColumn("status", F.when(n % 5 == 0, "skipped").otherwise("ran"))
    return ops.test_value(m, w)
