"""Queries over findings, gates and engine runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scoring
from ..operators import documents
from ..operators import findings as ops
from ..sources import reports
from .adapters import view

ENFORCED = {"tests": True, "secrets": True, "a11y": False, "sca": False, "perf": False}

# Pieces of oracle SQL.
PATH = "array_to_string(list_filter(string_split(replace(file, chr(92), '/'), '/'), lambda p: p <> '' AND p <> '.'), '/')"
SQUEEZED = "trim(regexp_replace(message, '\\s+', ' ', 'g'))"


def _part(p: str) -> str:
    return f"unhex(lpad(to_hex(strlen({p})), 16, '0')) || ({p})::BLOB"


FINGERPRINT = f"sha256('qualitylake-finding-v1'::BLOB || unhex('00') || {_part('rule')} || {_part(PATH)} || {_part(chr(39).join(['coalesce(symbol, ', '', ')']))} || {_part(SQUEEZED)})"
DISPOSITION = "CASE WHEN rule IN ('engine.unavailable', 'coverage.missing', 'coverage.unmatched', 'spec.llm_gap', 'sca.hallucinated_import') THEN 'ask' WHEN starts_with(rule, 'perf.') THEN 'ignore' WHEN severity = 'warning' THEN 'ask' ELSE 'fix' END"
PENALTY = "CASE WHEN rule IN ('coverage.missing', 'coverage.unmatched') THEN 0 WHEN engine = 'sca' AND severity = 'warning' THEN 1 WHEN severity = 'error' THEN 25 WHEN severity = 'warning' THEN 5 ELSE 0 END"
DIMENSION = "CASE WHEN engine IN ('compile', 'tests', 'config', 'lint', 'html') THEN 'correctness' WHEN engine = 'perf' THEN 'efficiency' WHEN engine IN ('secrets', 'sca') THEN 'security' WHEN engine = 'a11y' THEN 'a11y' ELSE 'maintainability' END"
SCORES = f"""SELECT repo, run_id, {', '.join(f"greatest(0, 1.0 - sum(CASE WHEN d = '{n}' THEN p ELSE 0 END) / 100.0)::DOUBLE AS {n}" for n in ('correctness', 'efficiency', 'maintainability', 'security', 'a11y'))}
  FROM (SELECT repo, run_id, {DIMENSION} AS d, {PENALTY} AS p FROM v_findings) GROUP BY repo, run_id"""
ORDER = "file, coalesce(start_line, 0), rule, symbol NULLS FIRST, id"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"SELECT id, {FINGERPRINT} AS fingerprint, {DISPOSITION} AS disposition, ({PENALTY} / 100.0)::DOUBLE AS penalty, {DIMENSION} AS dimension FROM v_findings", "v_findings")
def finding_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ops.with_disposition(ops.with_fingerprint(view(spark, sf_dir, "v_findings")))
    return f.select("id", "fingerprint", "disposition", scoring.penalty().alias("penalty"), scoring.dimension().alias("dimension"))


@query(f"SELECT id, row_number() OVER (PARTITION BY repo, run_id ORDER BY {ORDER}) AS place FROM v_findings", "v_findings")
def finding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ordered_findings(view(spark, sf_dir, "v_findings")).select("id", "place")


@query("SELECT id, row_number() OVER (PARTITION BY repo, run_id ORDER BY file, rule, id) AS place FROM v_findings", "v_findings")
def finding_order_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.merged_order(view(spark, sf_dir, "v_findings")).select("id", "place")


@query(
    """SELECT repo, run_id, CASE WHEN n > 1 THEN rule || '#' || n ELSE rule END AS id, start_line, message
    FROM (SELECT *, row_number() OVER (PARTITION BY repo, run_id, rule ORDER BY file, coalesce(start_line, 0), rule, symbol NULLS FIRST, message) AS n FROM v_findings)""",
    "v_findings",
)
def unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.unique_ids(view(spark, sf_dir, "v_findings").withColumn("id", F.col("rule"))).select("repo", "run_id", "id", "start_line", "message")


@query("SELECT repo, run_id, id, rule, file FROM v_findings WHERE severity = 'error'", "v_findings")
def list_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.list_findings(view(spark, sf_dir, "v_findings"), "error").select("repo", "run_id", "id", "rule", "file")


@query("SELECT repo, run_id, id, rule, message FROM v_findings WHERE id = 'e42'", "v_findings")
def explain_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.explain(view(spark, sf_dir, "v_findings"), "e42").select("repo", "run_id", "id", "rule", "message")


@query("SELECT repo, run_id, engine, message, suggested_action FROM v_findings WHERE engine = 'perf'", "v_findings")
def unavailable_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "v_findings")
    return ops.unavailable(f.withColumn("rule", F.when(F.col("engine") == "perf", "engine.unavailable").otherwise(F.col("rule"))))


@query("SELECT id, CASE WHEN repo = 'r0' THEN file ELSE repo || '/' || file END AS file FROM v_findings", "v_findings")
def prefix_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.prefix_paths(view(spark, sf_dir, "v_findings"), F.when(F.col("repo") == "r0", ".").otherwise(F.col("repo"))).select("id", "file")


@query("SELECT repo, rule, file FROM v_findings WHERE severity = 'error' UNION SELECT repo, rule, file FROM v_findings WHERE symbol IS NULL", "v_findings")
def append_new_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "v_findings")
    return ops.append_new(f.where("severity = 'error'").select("repo", "rule", "file"), f.where("symbol is null").select("repo", "rule", "file"))


@query(f"SELECT repo, run_id, {', '.join(f'round({n}, 9) AS {n}' for n in ('correctness', 'efficiency', 'maintainability', 'security', 'a11y'))} FROM ({SCORES})", "v_findings")
def dimension_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "v_findings")
    return _rounded(ops.scores(f, f))


GRADED = f"SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM (SELECT repo, run_id, CAST(floor((correctness + efficiency + maintainability + security + a11y) * 20 + 100 * 2.220446049250313e-16 + 0.5) AS INT) AS score FROM ({SCORES}))"


@query(GRADED, "v_findings")
def overall_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "v_findings")
    return ops.overall(_rounded(ops.scores(f, f)))


@query(f"""SELECT repo, run_id, '{{"schemaVersion":1,"label":"quality","message":"' || grade || ' (' || score || '/100)","color":"' || CASE grade WHEN 'A' THEN 'brightgreen' WHEN 'B' THEN 'green' WHEN 'C' THEN 'yellow' WHEN 'D' THEN 'orange' ELSE 'red' END || '"}}' AS badge FROM ({GRADED})""", "v_findings")
def badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = overall_scores(spark, sf_dir).withColumns({"analyzer_error": F.lit(False), "engines": F.lit(1)})
    return ops.badges(cards)


COUNTED = f"""(SELECT r.repo, r.run_id, g.id, g.enforced, g.noun, count(CASE WHEN f.engine = g.id AND (f.severity = 'error' OR g.id IN ('a11y', 'sca')) THEN 1 END) AS n
    FROM v_runs r CROSS JOIN (VALUES ('tests', true, NULL), ('secrets', true, 'secrets'), ('a11y', false, 'accessibility findings'), ('sca', false, 'undeclared dependencies'), ('perf', false, NULL)) g(id, enforced, noun)
    LEFT JOIN v_findings f ON f.repo = r.repo AND f.run_id = r.run_id GROUP BY ALL)"""
GATES = f"""SELECT repo, run_id, id, n = 0 AS pass, enforced, CASE WHEN n > 0 THEN n || ' ' || coalesce(noun, CASE WHEN n = 1 THEN id || ' finding' ELSE id || ' findings' END) || CASE WHEN enforced THEN '' ELSE ' (advisory; does not fail the process)' END END AS reason FROM {COUNTED}
    UNION ALL SELECT repo, run_id, 'lint', true, true, NULL FROM v_runs"""


@query(GATES, "v_findings v_runs")
def counting_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of all runs, those without findings included; no run has a linter's findings."""
    return ops.count_gates(view(spark, sf_dir, "v_findings"), {**ENFORCED, "lint": True}, runs=view(spark, sf_dir, "v_runs"))


@query(
    """SELECT repo, run_id, id, pass, enforced, reason FROM (SELECT r.repo, r.run_id, 'lint' AS id, coalesce(bad, 0) = 0 AND coalesce(away, 0) = 0 AS pass, true AS enforced, CASE WHEN bad > 0 THEN 'lint failed' WHEN away > 0 THEN 'lint unavailable' END AS reason
    FROM v_runs r LEFT JOIN (SELECT repo, run_id, count(CASE WHEN engine = 'perf' AND start_line < 20 THEN 1 END) AS bad, count(CASE WHEN engine = 'perf' AND start_line > 380 THEN 1 END) AS away FROM v_findings GROUP BY repo, run_id) f ON f.repo = r.repo AND f.run_id = r.run_id)""",
    "v_findings v_runs",
)
def lint_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The required linter's gate, with some of the performance findings as what it says."""
    f = view(spark, sf_dir, "v_findings").where("engine = 'perf' and (start_line < 20 or start_line > 380)")
    said = f.withColumns({"engine": F.lit("lint"), "rule": F.when(F.col("start_line") < 20, "lint.failed").otherwise("engine.unavailable")})
    return ops.count_gates(said, {"lint": True}, runs=view(spark, sf_dir, "v_runs"), required=("lint",))


@query(f"SELECT repo, run_id, bool_or(enforced AND n > 0) AS verdict_fails, bool_or(enforced AND n > 0 AND id = 'secrets') AS exit_fails FROM {COUNTED} GROUP BY repo, run_id", "v_findings v_runs")
def verdicts_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all runs, clean ones included."""
    runs = view(spark, sf_dir, "v_runs")
    return ops.verdicts(ops.count_gates(view(spark, sf_dir, "v_findings"), ENFORCED, runs=runs), ["secrets"], runs=runs)


@query("SELECT repo, run_id, bool_or(enforced AND NOT pass) AS verdict_fails, bool_or(enforced AND NOT pass AND id = 'tests') AS exit_fails FROM v_gates GROUP BY repo, run_id", "v_gates")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.verdicts(view(spark, sf_dir, "v_gates"), ["tests"])


@query(
    """SELECT repo, run_id, CASE WHEN f > 0 THEN 'fail' WHEN e = 0 AND a > 0 THEN 'report-only (' || a || ')' WHEN a > 0 THEN 'advisory (' || a || ')' ELSE 'pass' END AS outcome
    FROM (SELECT repo, run_id, count(CASE WHEN enforced AND NOT pass THEN 1 END) AS f, count(CASE WHEN NOT enforced AND NOT pass THEN 1 END) AS a, count(CASE WHEN enforced THEN 1 END) AS e FROM v_gates GROUP BY repo, run_id)""",
    "v_gates",
)
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.outcomes(view(spark, sf_dir, "v_gates"))


@query("SELECT f.repo, f.run_id, f.id, g.id AS gate FROM v_findings f JOIN v_gates g ON f.repo = g.repo AND f.run_id = g.run_id AND f.engine = g.id WHERE NOT g.pass", "v_findings v_gates")
def findings_of_failed_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.gate_findings(view(spark, sf_dir, "v_gates").where("not pass"), view(spark, sf_dir, "v_findings")).select("repo", "run_id", "id", "gate")


@query(
    """SELECT 'fleet' AS repo, run_id, id, bool_and(pass) AS pass, bool_or(enforced) AS enforced,
    string_agg(CASE WHEN NOT pass AND reason IS NOT NULL THEN repo || ': ' || reason END, '; ' ORDER BY repo) AS reason FROM v_gates GROUP BY run_id, id""",
    "v_gates",
)
def merged_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.merge_roots(view(spark, sf_dir, "v_gates").withColumn("root", F.col("repo")).withColumn("repo", F.lit("fleet")))


@query(
    f"""SELECT repo, run_id, place, rule, suggested_action, n, greatest(0, kinds - 2) AS more FROM (
      SELECT *, row_number() OVER (PARTITION BY repo, run_id ORDER BY n DESC, rule, suggested_action) AS place, count(*) OVER (PARTITION BY repo, run_id) AS kinds FROM (
        SELECT repo, run_id, rule, suggested_action, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY repo, run_id) AS total FROM v_findings)
        WHERE total > 8 AND {DISPOSITION} = 'fix' AND suggested_action IS NOT NULL GROUP BY repo, run_id, rule, suggested_action)) WHERE place <= 2""",
    "v_findings",
)
def fix_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fix_summary(view(spark, sf_dir, "v_findings"), top=2)


@query(f"SELECT id, place, more FROM (SELECT id, row_number() OVER (PARTITION BY repo, run_id ORDER BY {ORDER}) AS place, greatest(0, count(*) OVER (PARTITION BY repo, run_id) - 8) AS more FROM v_findings) WHERE place <= 8", "v_findings")
def first_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.first_findings(view(spark, sf_dir, "v_findings")).select("id", "place", "more")


@query("SELECT repo, engine, count(*) AS runs, CAST(sum(duration_ms) AS BIGINT) AS total_ms, row_number() OVER (PARTITION BY repo ORDER BY min(pos)) AS place FROM v_engine_runs GROUP BY repo, engine", "v_engine_runs")
def engine_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.engine_totals(view(spark, sf_dir, "v_engine_runs"))


@query(
    """SELECT *, row_number() OVER (PARTITION BY repo, run_id ORDER BY errors = 0, n, rule) AS place FROM (
    SELECT repo, run_id, rule, count(CASE WHEN severity = 'error' THEN 1 END) AS errors, count(CASE WHEN severity = 'warning' THEN 1 END) AS warnings, count(*) AS n FROM v_findings GROUP BY repo, run_id, rule)""",
    "v_findings",
)
def rule_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rule_groups(view(spark, sf_dir, "v_findings"))


@query("SELECT repo, run_id, rule, count(*) AS n, string_agg(DISTINCT file, ',' ORDER BY file) AS files FROM v_findings WHERE engine = 'a11y' GROUP BY repo, run_id, rule", "v_findings")
def a11y_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.a11y_groups(view(spark, sf_dir, "v_findings"))


@query(
    f"""SELECT w.repo, w.run_id, w.file, w.symbol, f.id AS finding_id, f.start_line AS finding_line FROM (SELECT DISTINCT repo, run_id, file, symbol FROM v_findings WHERE symbol IS NOT NULL AND severity = 'error') w
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY repo, run_id, file, symbol ORDER BY {ORDER}) AS n FROM v_findings) f ON f.repo = w.repo AND f.run_id = w.run_id AND f.file = w.file AND f.symbol = w.symbol AND f.n = 1""",
    "v_findings",
)
def locate_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "v_findings")
    return ops.locate(f.where("symbol is not null and severity = 'error'").select("repo", "run_id", "file", "symbol").distinct(), f)


FOLDED = "(SELECT repo, run_id, id, file, symbol, CASE engine WHEN 'tests' THEN 'crap.over_threshold' WHEN 'perf' THEN 'complexity.untested' ELSE rule END AS rule FROM v_findings)"


@query(
    f"""WITH f AS {FOLDED}, b AS (SELECT repo, run_id, file, symbol FROM f WHERE rule = 'complexity.untested' AND symbol IS NOT NULL INTERSECT SELECT repo, run_id, file, symbol FROM f WHERE rule = 'crap.over_threshold')
    SELECT f.id, f.rule, b.file IS NOT NULL AND rule = 'crap.over_threshold' AS untested FROM f LEFT JOIN b ON f.repo = b.repo AND f.run_id = b.run_id AND f.file = b.file AND f.symbol = b.symbol WHERE NOT (b.file IS NOT NULL AND rule = 'complexity.untested')""".replace("WITH f AS", ", f AS", 1),
    "v_findings",
)
def folded_untested(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "v_findings")
    return ops.fold_untested(f.withColumn("rule", F.when(F.col("engine") == "tests", "crap.over_threshold").when(F.col("engine") == "perf", "complexity.untested").otherwise(F.col("rule")))).select("id", "rule", "untested")


@query(f"SELECT repo, run_id, id, rule AS rule_id, CASE WHEN engine = 'secrets' AND severity IN ('error', 'warning') THEN severity WHEN severity IN ('error', 'warning') THEN 'warning' ELSE 'note' END AS level, file AS uri, greatest(start_line, 1) AS start_line, message, {FINGERPRINT} AS fingerprint FROM v_findings WHERE {DISPOSITION} <> 'ignore'", "v_findings")
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sarif_results(view(spark, sf_dir, "v_findings"))


@query(
    f"""SELECT g.repo, g.run_id, '2.1.0' AS version, coalesce(f.n, 0)::BIGINT AS results, f.first_rule, f.last_message, coalesce(f.rules, 0)::BIGINT AS rules, g.n AS gates
    FROM (SELECT repo, run_id, count(*) AS n FROM v_gates GROUP BY repo, run_id) g LEFT JOIN
    (SELECT repo, run_id, count(*) AS n, arg_min(rule, place) AS first_rule, arg_max(message, place) AS last_message, count(DISTINCT rule) AS rules
     FROM (SELECT *, row_number() OVER (PARTITION BY repo, run_id ORDER BY {ORDER}) AS place FROM v_findings WHERE {DISPOSITION} <> 'ignore') GROUP BY repo, run_id) f ON f.repo = g.repo AND f.run_id = g.run_id""",
    "v_findings v_gates",
)
def sarif_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, read again as JSON."""
    result = "struct<ruleId:string,message:struct<text:string>>"
    schema = f"struct<version:string,runs:array<struct<results:array<{result}>,tool:struct<driver:struct<rules:array<struct<id:string>>>>,properties:struct<gates:array<struct<id:string>>>>>>"
    d = ops.to_sarif(view(spark, sf_dir, "v_findings"), view(spark, sf_dir, "v_gates")).withColumn("j", F.from_json("sarif", schema)).withColumn("r", F.col("j.runs")[0])
    results = F.col("r.results")
    return d.select("repo", "run_id", "j.version", F.size(results).cast("long").alias("results"), F.get(results, F.lit(0))["ruleId"].alias("first_rule"), F.try_element_at(results, F.lit(-1))["message"]["text"].alias("last_message"), F.size("r.tool.driver.rules").cast("long").alias("rules"), F.size("r.properties.gates").cast("long").alias("gates"))


@query(
    f"""SELECT repo, run_id, row_number() OVER (PARTITION BY repo, run_id ORDER BY {ORDER}) AS place, rule AS rule_id, CASE WHEN engine = 'secrets' AND severity IN ('error', 'warning') THEN severity WHEN severity IN ('error', 'warning') THEN 'warning' ELSE 'note' END AS level,
    file AS uri, greatest(start_line, 1) AS start_line, message, {FINGERPRINT} AS fingerprint FROM v_findings WHERE {DISPOSITION} <> 'ignore'""",
    "v_findings",
)
def sarif_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written in small parts, joined and read again: every result with its place."""
    result = "struct<ruleId:string,level:string,message:struct<text:string>,partialFingerprints:struct<primaryLocationLineHash:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>"
    parts = documents.sarif_parts(view(spark, sf_dir, "v_findings"), view(spark, sf_dir, "v_gates"), limit=2048)
    read = documents.joined(parts).withColumn("j", F.from_json("text", f"struct<runs:array<struct<results:array<{result}>>>>"))
    each = read.select("repo", "run_id", F.posexplode(F.col("j.runs")[0]["results"]).alias("pos", "r"))
    where = F.col("r.locations")[0]["physicalLocation"]
    return each.select("repo", "run_id", (F.col("pos") + 1).cast("long").alias("place"), F.col("r.ruleId").alias("rule_id"), "r.level", where["artifactLocation"]["uri"].alias("uri"), where["region"]["startLine"].alias("start_line"), F.col("r.message.text").alias("message"), F.col("r.partialFingerprints.primaryLocationLineHash").alias("fingerprint"))


@query(
    """SELECT r.repo, r.run_id, CASE WHEN coalesce(g.fails, false) THEN 'fail' ELSE 'pass' END AS verdict, coalesce(g.n, 0)::BIGINT AS gates, coalesce(f.n, 0)::BIGINT AS findings, f.lines, coalesce(e.n, 0)::BIGINT AS engine_runs, e.slowest FROM v_runs r
    LEFT JOIN (SELECT repo, run_id, count(*) AS n, bool_or(enforced AND NOT pass) AS fails FROM v_gates GROUP BY repo, run_id) g ON g.repo = r.repo AND g.run_id = r.run_id
    LEFT JOIN (SELECT repo, run_id, count(*) AS n, CAST(sum(start_line) AS BIGINT) AS lines FROM v_findings GROUP BY repo, run_id) f ON f.repo = r.repo AND f.run_id = r.run_id
    LEFT JOIN (SELECT concat('r', CAST(user_id % 10 AS VARCHAR)) AS repo, CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, count(*) AS n, max(CAST(floor(value * 100) AS BIGINT)) AS slowest FROM events GROUP BY 1, 2) e ON e.repo = r.repo AND e.run_id = r.run_id""",
    "v_findings v_gates v_runs",
)
def report_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all runs, those without findings too, written in parts, joined and read again."""
    engine_runs = view(spark, sf_dir, "events").select(F.concat(F.lit("r"), (F.col("user_id") % 10).cast("string")).alias("repo"), F.col("ts").cast("date").cast("string").alias("run_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("engine"), F.floor(F.col("value") * 100).alias("duration_ms"))
    parts = documents.report_parts(view(spark, sf_dir, "v_runs"), view(spark, sf_dir, "v_gates"), view(spark, sf_dir, "v_findings"), engine_runs, limit=2048)
    read = reports.parse_reports(documents.joined(parts, "report"))
    lines = F.when(F.size("findings") > 0, F.aggregate("findings", F.lit(0).cast("long"), lambda n, f: n + f["span"]["start_line"]))
    return read.select("repo", "run_id", "verdict", F.size("gates").cast("long").alias("gates"), F.size("findings").cast("long").alias("findings"), lines.alias("lines"), F.size("runs").cast("long").alias("engine_runs"), F.array_max(F.transform("runs", lambda r: r["duration_ms"])).alias("slowest"))


GROUP_KEY = "sha256('qualitylake-group-v1'::BLOB || unhex('00') || " + _part("file") + " || " + _part("coalesce(symbol, '')") + ")"


@query(
    f"""SELECT repo, file, symbol, {GROUP_KEY} AS key, 'Findings: ' || CASE WHEN symbol IS NULL THEN file ELSE symbol || ' (' || file || ')' END AS title, CAST(count(*) AS INT) AS n, string_agg(fp, ',' ORDER BY fp) AS fingerprints
    FROM (SELECT *, {FINGERPRINT} AS fp FROM v_findings) GROUP BY repo, file, symbol""",
    "v_findings",
)
def ticket_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ticket_groups(view(spark, sf_dir, "v_findings")).withColumn("fingerprints", F.array_join("fingerprints", ","))


@query(
    f"""SELECT repo, file, symbol, {FINGERPRINT} AS fingerprint, 'Finding fingerprint: ' || {FINGERPRINT} || chr(10) || 'Rule: ' || rule || chr(10) || 'Engine: ' || engine || chr(10) || 'Severity: ' || severity || chr(10) || 'Location: ' || file || ':' || start_line
    || CASE WHEN symbol IS NULL THEN '' ELSE chr(10) || 'Symbol: ' || symbol END || chr(10) || 'Finding: ' || message || chr(10) || 'Suggested action: ' || coalesce(suggested_action, 'No suggested action was included in the report.') AS body FROM v_findings""",
    "v_findings",
)
def ticket_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ticket_comments(view(spark, sf_dir, "v_findings"))


@query(
    f"""SELECT repo, file, symbol, key, CASE WHEN left(key, 1) < '5' THEN NULL ELSE key END AS ticket_id, action, CASE WHEN action IN ('create', 'post') THEN CASE WHEN action = 'create' THEN every ELSE rest END END AS to_post FROM (
    SELECT *, CASE WHEN left(key, 1) < '5' THEN 'create' WHEN left(key, 1) = 'f' THEN 'error' WHEN substr(key, 2, 1) < '4' THEN 'archived' WHEN rest <> '' THEN 'post' ELSE 'unchanged' END AS action FROM (
    SELECT repo, file, symbol, {GROUP_KEY} AS key, string_agg(fp, ',' ORDER BY fp) AS every, coalesce(string_agg(CASE WHEN fp <> lowest THEN fp END, ',' ORDER BY fp), '') AS rest
    FROM (SELECT *, min(fp) OVER (PARTITION BY repo, file, symbol) AS lowest FROM (SELECT *, {FINGERPRINT} AS fp FROM v_findings)) GROUP BY repo, file, symbol))""",
    "v_findings",
)
def ticket_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets hold the first fingerprint of their group; groups are known, doubled or archived by their keys."""
    groups = ops.ticket_groups(view(spark, sf_dir, "v_findings"))
    known = groups.where(F.left("key", F.lit(1)) >= "5").withColumn("copy", F.explode(F.when(F.left("key", F.lit(1)) == "f", F.array(F.lit(""), F.lit("x"))).otherwise(F.array(F.lit("")))))
    tickets = known.select(F.concat("key", "copy").alias("id"), (F.substring("key", 2, 1) < "4").alias("archived"), F.array(F.concat(F.lit("group-"), "key")).alias("labels"), F.array(F.struct(F.element_at("fingerprints", 1).alias("body"))).alias("comments"))
    return ops.reconcile(groups, tickets).withColumn("to_post", F.array_join("to_post", ","))


RANK = ("compile", "tests", "secrets", "sca", "a11y")


@query("SELECT repo, string_agg(engine, ',' ORDER BY CASE engine WHEN 'tests' THEN 2 WHEN 'secrets' THEN 3 WHEN 'sca' THEN 4 WHEN 'a11y' THEN 5 ELSE 6 END, engine) FILTER (engine <> 'a11y') AS ran FROM (SELECT DISTINCT repo, engine FROM v_engine_runs) GROUP BY repo", "v_engine_runs")
def engines_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = view(spark, sf_dir, "v_engine_runs").groupBy("repo").agg(F.collect_set("engine").alias("engines"))
    return g.select("repo", F.array_join(ops.engine_order(F.col("engines"), list(RANK), F.array(F.lit("a11y"))), ",").alias("ran"))


@query(
    """SELECT f.repo, f.run_id, f.findings, f.rules, f.lines, g.gates, g.enforced, '' AS disposition FROM
    (SELECT repo, run_id, count(*) AS findings, count(DISTINCT rule) AS rules, CAST(sum(start_line) AS BIGINT) AS lines FROM v_findings GROUP BY repo, run_id) f JOIN
    (SELECT repo, run_id, count(*) AS gates, count(*) AS enforced FROM v_gates GROUP BY repo, run_id) g ON f.repo = g.repo AND f.run_id = g.run_id""",
    "v_findings v_gates",
)
def saved_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and gates packed as reports of an old form, without enforcement and dispositions, and read again."""
    f, g = view(spark, sf_dir, "v_findings"), view(spark, sf_dir, "v_gates")
    findings = f.groupBy("repo", "run_id").agg(F.collect_list(F.struct("id", "rule", "engine", "severity", "file", "message", F.struct("start_line").alias("span"))).alias("findings"))
    gates = g.groupBy("repo", "run_id").agg(F.collect_list(F.struct("id", "pass", "reason")).alias("gates"))
    texts = findings.join(gates, ["repo", "run_id"]).select(F.to_json(F.struct("repo", "run_id", "findings", "gates")).alias("report"))
    tables = reports.explode_reports(reports.parse_reports(texts))
    a = tables["findings"].groupBy("repo", "run_id").agg(F.count("*").alias("findings"), F.count_distinct("rule").alias("rules"), F.sum("start_line").alias("lines"), F.max("disposition").alias("disposition"))
    b = tables["gates"].groupBy("repo", "run_id").agg(F.count("*").alias("gates"), F.count_if("enforced").alias("enforced"))
    return a.join(b, ["repo", "run_id"])
