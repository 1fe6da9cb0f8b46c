"""Queries over document and page texts as source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import text as ops
from ..sources import code
from ..sources import pages as page_source
from .adapters import view


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; each 17th ends with a token of a known format, some of them with three places of one."""
    d = view(spark, sf_dir, "documents")
    h = F.sha2(F.col("doc_id").cast("string"), 256)
    token = F.when(F.col("doc_id") % 34 == 0, F.concat(F.lit("\nghp_"), F.left(h, F.lit(36)), F.lit("\nagain ghp_"), F.left(h, F.lit(36)), F.lit(" and ghp_"), F.left(h, F.lit(36)))).when(F.col("doc_id") % 51 == 0, F.concat(F.lit("\nkey AKIA"), F.upper(F.left(h, F.lit(16))))).when(F.col("doc_id") % 17 == 0, F.concat(F.lit("\nsk_live_"), F.left(h, F.lit(24)))).otherwise("")
    return d.select(F.col("source").alias("repo"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.coalesce("text", F.lit("")), token).alias("content"), "doc_id")


#: The rules' patterns for an engine without look-ahead: the longest run is taken and its length is checked.
SQL_RULES = [
    ("secrets.aws_access_key", r"\b((?:AKIA|ASIA)[A-Z0-9]{16})\b"),
    ("secrets.aws_secret_key", r"""(?i:aws_secret_access_key|aws_secret_key|secret_key)["']?\s*[:=]\s*["']?([A-Za-z0-9/+=]{40,})"""),
    ("secrets.github_token", r"\b(gh[pousr]_[A-Za-z0-9]{36,})\b"),
    ("secrets.slack_token", r"\b(xox[abprs]-[A-Za-z0-9-]{10,})"),
    ("secrets.slack_webhook", r"(https://hooks\.slack\.com/services/T[A-Za-z0-9]+/B[A-Za-z0-9]+/[A-Za-z0-9]{16,})"),
    ("secrets.stripe_key", r"\b((?:sk|rk)_live_[A-Za-z0-9]{16,})\b"),
    ("secrets.generic_token", r"""(?i:token)["']?\s*[:=]\s*["']([A-Za-z0-9_.-]{32,})["']"""),
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


FILES = """(SELECT source AS repo, 'doc_' || doc_id || '.md' AS file, coalesce(text, '') || CASE WHEN doc_id % 34 = 0 THEN chr(10) || 'ghp_' || left(sha256(doc_id::VARCHAR), 36) || chr(10) || 'again ghp_' || left(sha256(doc_id::VARCHAR), 36) || ' and ghp_' || left(sha256(doc_id::VARCHAR), 36) WHEN doc_id % 51 = 0 THEN chr(10) || 'key AKIA' || upper(left(sha256(doc_id::VARCHAR), 16))
    WHEN doc_id % 17 = 0 THEN chr(10) || 'sk_live_' || left(sha256(doc_id::VARCHAR), 24) ELSE '' END AS content FROM documents)"""
STEPS = "list_transform(range(1, greatest(length(body), 2)), lambda i: ascii(substr(body, i + 1, 1)) - ascii(substr(body, i, 1)))"
LINES = f"(SELECT repo, file, unnest(string_split(content, chr(10))) AS content, CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INT) AS line FROM {FILES})"
SECRETS = f"""(SELECT repo, rule, file, line, body FROM (
    {" UNION ALL ".join(f"SELECT repo, {_quoted(r)} AS rule, file, line, unnest(regexp_extract_all(content, {_quoted(p)}, 1)) AS body FROM {LINES}" for r, p in SQL_RULES)}) s
    WHERE NOT (rule = 'secrets.aws_secret_key' AND length(body) <> 40) AND NOT regexp_matches(body, '(?i)example|x{{6,}}|[*]{{4,}}|0{{12,}}|placeholder|changeme')
    AND NOT len(list_filter({STEPS}, lambda d: d IN (0, 1))) * 2 > greatest(length(body) - 1, 1)
    AND list_sum(list_transform(list_distinct(string_split(body, '')), lambda c: -((length(body) - length(replace(body, c, ''))) / length(body)::DOUBLE) * log2((length(body) - length(replace(body, c, ''))) / length(body)::DOUBLE))) >= 3.0)"""


@query(f"SELECT DISTINCT file, rule FROM {SECRETS}")
def planted_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rules each document meets, planted tokens and those of its own text."""
    return ops.secret_findings(_files(spark, sf_dir)).select("file", "rule").distinct()


@query(f"SELECT repo, rule, 'error' AS severity, file, line FROM {SECRETS}")
def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.secret_findings(_files(spark, sf_dir)).select("repo", "rule", "severity", "file", "line")


@query(
    """SELECT 'pages' AS repo, page_id::VARCHAR AS file, 'run' AS symbol, CAST(start AS INT) AS start_line, CAST(start + 1 + length(body) - length(replace(body, chr(10), '')) + 1 AS INT) AS end_line, 3 AS cc FROM (
    SELECT page_id, len(string_split(split_part(html, '<script', 1), chr(10))) AS start, regexp_extract(html, '<script>(.*?)</script>', 1) AS body FROM pages WHERE contains(html, '<script>'))"""
)
def page_script_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of inline scripts, with a function put around each script's text."""
    s = page_source.inline_scripts(view(spark, sf_dir, "pages"))
    scripts = s.select(F.lit("pages").alias("repo"), F.col("page_id").cast("string").alias("path"), "line", F.concat(F.lit("function run() { if (ready && on) {\n"), "body", F.lit("\n} }")).alias("body"))
    return code.script_functions(scripts)


@query(
    """SELECT repo, rule, 'warning' AS severity, missing FROM (
    SELECT DISTINCT repo, 'spec.missing_file' AS rule, 'src/o' || CAST(o_orderkey AS VARCHAR) || '.rs' AS missing FROM v_specs WHERE odd
    UNION ALL SELECT DISTINCT repo, 'spec.missing_item', 'fn gone_' || CAST(o_orderkey AS VARCHAR) FROM v_specs WHERE odd
    UNION ALL SELECT DISTINCT repo, 'spec.missing_item', 'struct Kept' || CAST(o_orderkey AS VARCHAR) FROM v_specs WHERE NOT odd)""",
    "v_specs",
)
def spec_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as specs that name a file and two items; every order that is not open has the file and the function."""
    s = view(spark, sf_dir, "v_specs")
    path, fn = F.concat(F.lit("src/o"), F.col("o_orderkey").cast("string"), F.lit(".rs")), F.when(F.col("odd"), F.concat(F.lit("gone_"), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("kept_"), F.col("o_orderkey").cast("string")))
    there = F.when(F.col("odd"), F.lit("")).otherwise(F.concat(F.lit(", struct Kept"), F.col("o_orderkey").cast("string")))
    specs = s.select("repo", F.concat(F.lit("See https://a.example/b.html and "), path, F.lit(": fn "), fn, there, F.lit(".")).alias("text"))
    files = s.where("not odd").select("repo", path.alias("path"), F.concat(F.lit("pub fn "), fn, F.lit("() {}\nstruct Kept;\n")).alias("content"))
    return ops.spec_gaps(specs, files, code.pub_items(files))


WORDS = r"regexp_split_to_array(content, '[^A-Za-z0-9_]+')"


@query(
    f"""WITH f AS (SELECT repo, file, list_filter(list_distinct({WORDS}), lambda w: length(w) >= 3) AS words, {WORDS}[1] AS first FROM {FILES}),
    h AS (SELECT DISTINCT f.repo, f.file FROM (SELECT repo, file, unnest(words) AS word FROM f) f JOIN (SELECT DISTINCT repo, first FROM f WHERE length(first) > 11) s ON s.repo = f.repo AND s.first = f.word)
    SELECT repo, count(*) > 8 AS every, CASE WHEN count(*) > 8 THEN '' ELSE string_agg(file, ',' ORDER BY file) END AS tests FROM h GROUP BY repo"""
)
def targeted_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as test files, their first words, where they are long, as changed symbols."""
    f = _files(spark, sf_dir).withColumn("tests", F.array("path"))
    first = F.split("content", r"\W+")[0]
    out = ops.targeted_tests(f, f.where(F.length(first) > 11).select("repo", F.concat(F.lit("m::"), first).alias("symbol")))
    return out.select("repo", (F.size("tests") == 0).alias("every"), F.array_join("tests", ",").alias("tests"))
