"""Queries over paths, deltas and incremental scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import paths
from ..operators import scope as ops
from .adapters import view

GLOBS = ["tests/**", "./vendor/**", "src/target/**", "  ", "src/generated"]


@query(
    """SELECT repo, path FROM v_paths WHERE NOT (regexp_matches(path, '(^|/)tests/') OR regexp_matches(path, '(^|/)vendor/') OR regexp_matches(path, '(^|/)src/target/') OR starts_with(path, 'src/generated/'))""",
    "v_paths",
)
def exclude_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.exclude_paths(view(spark, sf_dir, "v_paths"), GLOBS).select("repo", "path")


@query("SELECT repo, path FROM v_paths WHERE NOT (starts_with(path, 'target/') OR regexp_matches(path, '(^|/)generated/'))", "v_paths")
def exclude_paths_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.exclude_paths(view(spark, sf_dir, "v_paths"), ["target/**", "**/generated/**"], anchored=True).select("repo", "path")


@query("SELECT repo, path FROM v_paths WHERE NOT (starts_with(path, 'vendor/') OR starts_with(path, 'target/') OR starts_with(path, '.hidden/') OR starts_with(path, 'src/generated/'))", "v_paths")
def skip_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.skip_dirs(view(spark, sf_dir, "v_paths")).select("repo", "path")


@query("SELECT repo, path FROM v_paths WHERE NOT (starts_with(path, 'target/') OR starts_with(path, '.hidden/') OR starts_with(path, 'src/generated/'))", "v_paths")
def skip_dirs_with_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.skip_dirs(view(spark, sf_dir, "v_paths"), include=["vendor/**"]).select("repo", "path")


@query(
    """SELECT repo, path, starts_with(path, '._') AS os_metadata, starts_with(path, 'tests/') OR regexp_matches(path, '_test\\.go$') AS test_code,
    CASE WHEN ends_with(path, '.rs') THEN 'rust' WHEN ends_with(path, '.ts') THEN 'node' WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.go') THEN 'go' WHEN ends_with(path, '.java') THEN 'java' WHEN ends_with(path, '.sh') THEN 'bash' END AS language FROM v_paths""",
    "v_paths",
)
def path_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "v_paths")
    return p.select("repo", "path", paths.is_os_metadata("path").alias("os_metadata"), paths.is_test_path("path").alias("test_code"), paths.language_of("path").alias("language"))


@query("SELECT repo, count(*) AS n, min(path) AS first_path FROM v_paths WHERE starts_with(path, '._') GROUP BY repo", "v_paths")
def os_metadata_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.os_metadata_warning(view(spark, sf_dir, "v_paths"))


@query("SELECT p.repo, p.path FROM v_paths p JOIN v_changed c ON p.repo = c.repo AND p.path = c.path WHERE regexp_matches(p.path, '\\.(py|go|rs)$')", "v_paths v_changed")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "v_paths").where(paths.language_of("path").isin("python", "go", "rust"))
    return ops.changed_files(p, view(spark, sf_dir, "v_changed")).select("repo", "path")


@query(
    """SELECT DISTINCT f.* FROM v_functions f JOIN (SELECT repo, file, min(line) AS low, max(line) AS high, bool_or(hits > 0) AS new FROM (SELECT repo, replace(report_path, '/ci/build/', '') AS file, line, hits FROM v_cov_lines) GROUP BY repo, file HAVING count(*) < 4) d
    ON d.repo = f.repo AND d.file = f.file AND (d.new OR d.low BETWEEN f.start_line AND f.end_line OR d.high BETWEEN f.start_line AND f.end_line)""",
    "v_functions v_cov_lines",
)
def changed_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = view(spark, sf_dir, "v_cov_lines").withColumn("path", F.replace("report_path", F.lit("/ci/build/"), F.lit("")))
    few = lines.groupBy("repo", "path").agg(F.min("line").alias("low"), F.max("line").alias("high"), F.bool_or(F.col("hits") > 0).alias("is_new_file"), F.count("*").alias("n")).where("n < 4")
    ranges = few.select("repo", "path", F.explode(F.array("low", "high")).alias("first")).withColumn("last", F.col("first"))
    return ops.changed_functions(view(spark, sf_dir, "v_functions"), ranges, few.where("is_new_file"))


@query("SELECT repo, file, symbol FROM v_functions WHERE NOT (cc < 20)", "v_functions")
def new_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "v_functions")
    return ops.new_symbols(f, f.where("cc < 20")).select("repo", "file", "symbol")


@query("SELECT repo, count(*) AS others FROM (SELECT repo, path FROM v_paths EXCEPT SELECT repo, path FROM v_changed) GROUP BY repo", "v_paths v_changed")
def other_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.other_paths(view(spark, sf_dir, "v_paths"), view(spark, sf_dir, "v_changed"))


ROOTS = "(SELECT DISTINCT repo, CASE key % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'a/b' WHEN 2 THEN 'a/b/c' ELSE 'd/e' END AS root, CASE WHEN key % 3 = 0 THEN 'go' ELSE 'node' END AS pack FROM v_paths)"


@query(f"SELECT * FROM {ROOTS} r WHERE NOT EXISTS (SELECT 1 FROM {ROOTS} u WHERE u.repo = r.repo AND u.pack = r.pack AND starts_with(r.root, u.root || '/'))", "v_paths")
def independent_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "v_paths")
    k = F.col("key") % 4
    roots = p.select("repo", F.when(k == 0, "a").when(k == 1, "a/b").when(k == 2, "a/b/c").otherwise("d/e").alias("root"), F.when(F.col("key") % 3 == 0, "go").otherwise("node").alias("pack")).distinct()
    return ops.independent_roots(roots)


@query("SELECT id, file FROM (SELECT id, repo, CASE WHEN symbol IS NULL THEN '.' ELSE file END AS file, engine FROM v_findings) f WHERE engine = 'secrets' AND (file = '.' OR file IN ('src/m1', 'src/m2', 'src/m3'))", "v_findings")
def scoped_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "v_findings").where("engine = 'secrets'").withColumn("file", F.when(F.col("symbol").isNull(), ".").otherwise(F.col("file")))
    changed = f.select("repo").distinct().withColumn("path", F.explode(F.array(*[F.lit(f"src/m{i}") for i in (1, 2, 3)])))
    return ops.scope_secrets(f, changed).select("id", "file")


@query("SELECT repo, path, bool_or(s) AS scored FROM (SELECT repo, path, true AS s FROM v_paths WHERE ends_with(path, '.py') UNION ALL SELECT repo, path, false FROM v_paths) GROUP BY repo, path", "v_paths")
def known_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "v_paths")
    return ops.known_paths(p.where("path like '%.py'"), p)


@query("SELECT DISTINCT repo, path FROM v_paths", "v_paths")
def scope_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.scope_paths(view(spark, sf_dir, "v_paths"))


@query("SELECT repo, path FROM v_changed UNION SELECT repo, path FROM v_paths WHERE size > 100000 AND trim(path) <> ''", "v_changed v_paths")
def changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.changed_paths(view(spark, sf_dir, "v_changed"), view(spark, sf_dir, "v_paths").where("size > 100000"))


@query("SELECT repo, string_agg(CASE WHEN n <= 3 THEN path END, ', ' ORDER BY path) || CASE WHEN count(*) > 3 THEN ' +' || (count(*) - 3) || ' more' ELSE '' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS n FROM (SELECT DISTINCT repo, path FROM v_changed)) GROUP BY repo", "v_changed")
def changed_paths_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.changed_paths_label(view(spark, sf_dir, "v_changed"))


@query("SELECT repo, CAST(sum(CASE WHEN key % 4 = 1 THEN size WHEN key % 5 = 0 THEN 0 ELSE key % 100 END) AS BIGINT) AS added FROM v_paths WHERE key % 2 = 1 GROUP BY repo", "v_paths")
def added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "v_paths")
    stat = p.where("key % 4 <> 1").select("repo", "path", F.when(F.col("key") % 5 == 0, "-").otherwise((F.col("key") % 100).cast("string")).alias("added"))
    return ops.added_lines(stat, p.select("repo", "path", F.col("size").alias("loc")), p.where("key % 2 = 1"))


@query("SELECT DISTINCT repo, 'scope.empty' AS rule, 'warning' AS severity FROM v_paths WHERE repo NOT IN (SELECT repo FROM v_paths WHERE key < 12)", "v_paths")
def empty_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "v_paths")
    return ops.empty_scope(p, p.where("key < 12"))


@query("SELECT doc_id, source FROM documents WHERE split_part(coalesce(text, ''), chr(10), 1) <> 'The.'")
def missing_license_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.missing_license_header(view(spark, sf_dir, "documents"), "The.", "text").select("doc_id", "source")


@query("SELECT concat('r', CAST(doc_id % 10 AS VARCHAR)) AS repo, sha256(text) AS hash, concat(source, '/doc_', CAST(doc_id AS VARCHAR), '.md') AS path FROM documents WHERE doc_id % 2 = 1 AND contains(text, 'Apache License')")
def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents are known as clean; the scan looks for licence sentences in the rest."""
    d = view(spark, sf_dir, "documents")
    files = d.select(F.concat(F.lit("r"), (F.col("doc_id") % 10).cast("string")).alias("repo"), F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"), "doc_id")
    clean = files.where("doc_id % 2 = 0").select(F.sha2(F.col("content").cast("binary"), 256).alias("hash"), "path")
    found, _ = ops.scan_incremental(files, clean, lambda f: f.where(F.contains("content", F.lit("Apache License"))).select("repo", F.col("path").alias("file"), "hash"))
    return found.select("repo", "hash", F.col("file").alias("path"))


@query(
    "SELECT repo, id, 3 AS line, split_part(message, chr(10), 3) AS text FROM v_commits WHERE regexp_matches(lower(split_part(message, chr(10), 3)), '^(signed|co-authored|reviewed)-by:')",
    "v_commits",
)
def attribution_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.attribution_hits(view(spark, sf_dir, "v_commits"), r"\b(signed|co-authored|reviewed)-by:")


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as binary files; some start as objects do, and sizes of some are beyond what is scanned."""
    d = view(spark, sf_dir, "documents")
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    head = F.when(n % 5 == 0, F.unhex(F.lit("7F454C46"))).when(n % 5 == 1, F.unhex(F.lit("FFD8FFE0"))).otherwise(F.lit(b""))
    content = F.concat(head, F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return d.select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), content.alias("content"), F.when(n % 7 == 0, F.lit(65 << 20)).otherwise(n).alias("size"))


SIZES = "(SELECT source AS repo, doc_id::VARCHAR AS path, CASE WHEN coalesce(length(text), 0) % 5 = 0 THEN 'object' WHEN coalesce(length(text), 0) % 7 = 0 THEN 'partial' ELSE 'scan' END AS route FROM documents)"


@query(f"SELECT repo, route, count(*) AS n FROM {SIZES} GROUP BY repo, route")
def file_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.route_files(_bodies(spark, sf_dir)).groupBy("repo", "route").agg(F.count("*").alias("n"))


@query(f"SELECT repo, 'secrets.partial' AS rule, 'error' AS severity, string_agg(path, ', ' ORDER BY path) AS paths FROM {SIZES} WHERE route = 'partial' GROUP BY repo")
def partial_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.partial_scan(ops.route_files(_bodies(spark, sf_dir)))


@query("SELECT repo, 'scope.generated' AS rule, 'warning' AS severity, count(*) AS n, string_agg(CASE WHEN k <= 5 THEN path END, ', ' ORDER BY path) AS first FROM (SELECT source AS repo, 'd' || doc_id || '.py' AS path, row_number() OVER (PARTITION BY source ORDER BY 'd' || doc_id || '.py') AS k FROM documents WHERE coalesce(length(text), 0) % 9 IN (0, 1)) GROUP BY repo")
def generated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "documents")
    n = F.coalesce(F.length("text"), F.lit(0)) % 9
    head = F.when(n == 0, F.lit("# @generated by a tool\n")).when(n == 1, F.lit("/* header\n * Code generated by x. DO NOT EDIT.\n */\n")).when(n == 2, F.lit("x = 1\n# @generated too late\n")).otherwise(F.lit(""))
    files = d.select(F.col("source").alias("repo"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.concat(head, F.coalesce("text", F.lit(""))).alias("content"))
    return ops.generated_warning(files)


MARKED = """(SELECT repo, split_part(path, '/', 1) AS root, (CAST(substr(repo, 2) AS INT) * 7 + length(split_part(path, '/', 1))) % 41 % 6 AS n, bool_or(ends_with(path, '.rs')) AS rust_lang, bool_or(ends_with(path, '.go')) AS go_lang, bool_or(ends_with(path, '.ts')) AS node_lang,
    bool_or(regexp_matches(path, '^[^/]*/f[0-9]*[.]sh$')) AS sh FROM v_paths WHERE contains(path, '/') GROUP BY 1, 2, 3)"""


@query(
    f"""SELECT repo, root, CASE WHEN len(marked) = 1 THEN marked[1] WHEN rust_lang AND NOT go_lang THEN 'rust' WHEN go_lang AND NOT rust_lang THEN 'go' ELSE 'ambiguous' END AS pack, array_to_string(list_sort(marked), ',') AS markers
    FROM (SELECT repo, root, [x for x in [CASE WHEN n IN (1, 2) THEN 'go' END, CASE WHEN n = 3 THEN 'csharp' END, CASE WHEN n = 4 AND (node_lang OR NOT sh) THEN 'node' END, CASE WHEN n IN (0, 1) THEN 'rust' END] if x IS NOT NULL] AS marked,
      rust_lang, go_lang FROM {MARKED}) m WHERE len(marked) > 0
    UNION ALL SELECT repo, '.', 'web', '' FROM v_paths GROUP BY repo""",
    "v_paths",
)
def packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top directories as roots by marker files, a project file or a build file that their names and repositories
    choose, below a repository root with a page."""
    top = F.split("path", "/")[0]
    p = view(spark, sf_dir, "v_paths").select("repo", "path")
    nested = p.where("path like '%/%'").select("repo", top.alias("top")).distinct().withColumn("n", (F.substring("repo", 2, 9).cast("int") * 7 + F.length("top")) % 41 % 6)
    names = {0: ["Cargo.toml"], 1: ["Cargo.toml", "go.mod"], 2: ["go.mod"], 3: ["App.csproj"], 4: ["package.json"], 5: ["Makefile"]}
    chosen = F.try_element_at(F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("n"))
    marks = nested.select("repo", "top", F.explode(chosen).alias("name")).select("repo", F.concat_ws("/", "top", "name").alias("path"))
    index = p.select("repo", F.lit("index.html").alias("path")).distinct()
    return ops.detect_packs(p.unionByName(marks).unionByName(index))
