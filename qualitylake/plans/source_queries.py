"""Readers over report texts that Spark writes from the fact tables; each must give the facts back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import query
from ..functions import scoring
from ..operators import text
from ..sources import code, coverage_reports, diffs, logs
from .adapters import view

LINES = "SELECT repo, report_path AS file, line, CAST(hits AS BIGINT) AS hits FROM v_cov_lines"


def _reports(spark: SparkSession, sf_dir: str, head: Column, item: Column, sep: str, tail: str) -> DataFrame:
    """A report per file: its head, an item per line in order, and its tail."""
    lines = view(spark, sf_dir, "v_cov_lines").withColumn("item", item)
    g = lines.groupBy("repo", "report_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "item"))), lambda x: x["item"]), sep).alias("body"))
    return g.select("repo", F.col("report_path").alias("report"), F.concat(head, "body", F.lit(tail)).alias("text"))


def _facts(df: DataFrame) -> DataFrame:
    return df.select("repo", "file", "line", "hits")


@query(LINES, "v_cov_lines")
def coverage_lcov(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reports(spark, sf_dir, F.concat(F.lit("TN:\nSF:"), "report_path", F.lit("\n")), F.format_string("DA:%d,%d", "line", "hits"), "\n", "\nend_of_record\n")
    return _facts(coverage_reports.cov_lcov(r))


@query(LINES, "v_cov_lines")
def coverage_cobertura(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reports(spark, sf_dir, F.concat(F.lit('<coverage><class name="c" filename="'), "report_path", F.lit('"><lines><line number="0" hits="1"/>')), F.format_string('<line number="%d" hits="%d"/>', "line", "hits"), "\n", "</lines></class></coverage>")
    return _facts(coverage_reports.cov_cobertura(r))


@query(LINES, "v_cov_lines")
def coverage_clover(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reports(spark, sf_dir, F.concat(F.lit('<coverage><file name="'), "report_path", F.lit('">')), F.format_string('<line num="%d" type="stmt" count="%d"/>', "line", "hits"), "", "</file></coverage>")
    return _facts(coverage_reports.cov_clover(r))


@query(LINES, "v_cov_lines")
def coverage_istanbul(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = view(spark, sf_dir, "v_cov_lines")
    g = lines.groupBy("repo", "report_path").agg(F.map_from_entries(F.collect_list(F.struct(F.col("line").cast("string"), F.struct(F.struct("line").alias("start"))))).alias("m"), F.map_from_entries(F.collect_list(F.struct(F.col("line").cast("string"), "hits"))).alias("s"))
    r = g.select("repo", F.col("report_path").alias("report"), F.to_json(F.create_map("report_path", F.struct(F.col("report_path").alias("path"), F.col("m").alias("statementMap"), "s"))).alias("text"))
    return _facts(coverage_reports.cov_istanbul(r))


@query(LINES, "v_cov_lines")
def coverage_pytest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = view(spark, sf_dir, "v_cov_lines")
    g = lines.groupBy("repo", "report_path").agg(F.collect_list(F.when(F.col("hits") > 0, F.col("line"))).alias("executed_lines"), F.collect_list("line").alias("missing_lines"))
    r = g.select("repo", F.col("report_path").alias("report"), F.to_json(F.struct(F.create_map("report_path", F.struct("executed_lines", "missing_lines")).alias("files"))).alias("text"))
    return _facts(coverage_reports.cov_pytest(r))


@query("SELECT repo, report_path AS file, line AS start_line, line AS end_line, CAST(1 AS BIGINT) AS statements, CAST(hits AS BIGINT) AS hits FROM v_cov_lines", "v_cov_lines")
def coverage_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reports(spark, sf_dir, F.lit("mode: set\n"), F.format_string("%s:%d.1,%d.9 1 %d", "report_path", "line", "line", "hits"), "\n", "\n")
    return coverage_reports.cov_go(r).drop("report")


@query("SELECT repo, round(sum(CASE WHEN hits > 0 THEN 1 ELSE 0 END) / count(*)::DOUBLE, 9) AS line_rate FROM v_cov_lines GROUP BY repo", "v_cov_lines")
def coverage_go_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage_reports.go_line_rate(coverage_go(spark, sf_dir)).select("repo", F.round("line_rate", 9).alias("line_rate"))


@query("SELECT repo, file, symbol, start_line, CAST(cc AS BIGINT) AS covered, CAST(50 - cc AS BIGINT) AS missed FROM v_functions", "v_functions")
def coverage_jacoco(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "v_functions")
    method = F.format_string('<method name="%s" desc="()V" line="%d"><counter type="LINE" missed="%d" covered="%d"/></method>', "symbol", "start_line", F.lit(50) - F.col("cc"), "cc")
    g = f.groupBy("repo", "file").agg(F.array_join(F.collect_list(method), "").alias("m"))
    r = g.select("repo", F.col("file").alias("report"), F.concat(F.lit('<package name="src"><class name="x" sourcefilename="'), F.substring("file", 5, 99), F.lit('"><method name="&lt;init&gt;" line="1"><counter type="LINE" missed="1" covered="1"/></method>'), "m", F.lit("</class></package>")).alias("text"))
    return coverage_reports.cov_jacoco(r).drop("report")


@query("SELECT repo, file, symbol AS name, round(cc / 50.0, 9)::DOUBLE AS coverage FROM v_functions", "v_functions")
def coverage_llvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function's region holds all of its lines, another one its first cc lines again, with a count."""
    f = view(spark, sf_dir, "v_functions")
    region = lambda last, n: F.array(F.col("start_line"), F.lit(1), last, F.lit(2), F.lit(n), F.lit(0), F.lit(0), F.lit(0))
    one = F.struct(F.col("symbol").alias("name"), F.lit(1).alias("count"), F.array("file").alias("filenames"), F.array(region(F.col("end_line"), 0), region(F.col("start_line") + F.col("cc") - 1, 3)).alias("regions"))
    g = f.groupBy("repo", "file").agg(F.collect_list(one).alias("functions"))
    r = g.select("repo", F.col("file").alias("report"), F.to_json(F.struct(F.array(F.struct("functions")).alias("data"))).alias("text"))
    return coverage_reports.cov_llvm(r).select("repo", "file", "name", F.round("coverage", 9).alias("coverage"))


@query("SELECT repo, summary, file, CAST(pos AS INT) AS line, concat('m', CAST(pos AS VARCHAR)) AS name FROM v_mutants", "v_mutants")
def mutant_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "v_mutants")
    mutant = F.struct(F.concat(F.lit("m"), F.col("pos").cast("string")).alias("name"), "file", F.struct(F.struct(F.col("pos").alias("line")).alias("start")).alias("span"))
    outcome = F.struct("summary", F.struct(mutant.alias("Mutant")).alias("scenario"))
    # reports of bounded length, whatever a file's mutants
    r = m.groupBy("repo", "file", F.floor(F.col("pos") / 20_000)).agg(F.to_json(F.struct(F.collect_list(outcome).alias("outcomes"))).alias("text"))
    return logs.mutants(r)


@query("SELECT repo, concat('compile:', file, ':', CAST(start_line AS VARCHAR), ':1') AS id, 'compile.error' AS rule, 'error' AS severity, file, start_line, 'E1' AS code, message FROM v_findings WHERE severity = 'error'", "v_findings")
def compiler_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "v_findings")
    span = lambda line, primary: F.struct(F.col("file").alias("file_name"), line.alias("line_start"), F.lit(1).alias("column_start"), F.lit(primary).alias("is_primary"))
    message = F.struct(F.col("severity").alias("level"), "message", F.struct(F.lit("E1").alias("code")).alias("code"), F.array(span(F.lit(9999), False), span(F.col("start_line"), True)).alias("spans"))
    return logs.compiler_findings(f.select("repo", F.to_json(F.struct(F.lit("compiler-message").alias("reason"), message.alias("message"))).alias("line")))


@query("SELECT repo, concat('t::', id) AS name, concat('src/', id, '.rs') AS file, start_line, message AS detail FROM v_findings WHERE engine = 'tests'", "v_findings")
def test_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "v_findings").where("engine = 'tests'")
    text = F.format_string("test t::%s ... FAILED\ntest t::ok ... ok\nthread 't::%s' panicked at src/%s.rs:%d:1:\n%s\n", "id", "id", "id", "start_line", "message")
    r = f.groupBy("repo", F.concat_ws("/", "run_id", F.crc32("id") % 64).alias("log")).agg(F.array_join(F.collect_list(text), "").alias("text"))
    return logs.test_failures(r).select("repo", "name", "file", "start_line", "detail")


@query("SELECT repo, id AS log, severity, message, file, start_line FROM v_findings", "v_findings")
def lint_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log per finding: a located warning and a place-less error come first, then the finding."""
    f = view(spark, sf_dir, "v_findings")
    body = F.format_string("%s[E9]: %s\n  |\n  --> %s:%d:7\n", "severity", "message", "file", "start_line")
    noise = F.when(F.col("severity") == "error", F.lit("warning: first\n --> x.rs:1:1\nerror: nowhere\n")).otherwise(F.lit("error: nowhere\n"))
    return logs.lint_first_diagnostic(f.select("repo", F.col("id").alias("log"), F.concat(noise, body).alias("text")))


@query("SELECT DISTINCT repo, file AS path, line FROM (SELECT repo, report_path AS file, line FROM v_cov_lines UNION ALL SELECT repo, report_path, line + 1 FROM v_cov_lines)", "v_cov_lines")
def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reports(spark, sf_dir, F.concat(F.lit("--- a/x\n+++ b/"), "report_path", F.lit("\n")), F.format_string("@@ -1,1 +%d,2 @@ f\n+a\n b\n@@ -9 +7,0 @@", "line"), "\n", "\n")
    return diffs.changed_lines(r.withColumnRenamed("report", "patch")).select("repo", "path", F.explode("changed_lines").alias("line"))


@query("SELECT repo, report_path AS path, kind, new_line, count(*) AS n FROM (SELECT repo, report_path, 'added' AS kind, line AS new_line FROM v_cov_lines UNION ALL SELECT repo, report_path, 'context', line + 1 FROM v_cov_lines UNION ALL SELECT repo, report_path, 'removed', NULL FROM v_cov_lines) GROUP BY ALL", "v_cov_lines")
def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reports(spark, sf_dir, F.concat(F.lit("--- a/x\n+++ b/"), "report_path", F.lit("\n")), F.format_string("@@ -1,2 +%d,2 @@\n-old\n+new\n same", "line"), "\n", "")
    return diffs.parse_diffs(r.withColumnRenamed("report", "patch")).groupBy("repo", "path", "kind", "new_line").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT repo, 'src' AS dir, module FROM v_imports", "v_imports")
def declared_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = view(spark, sf_dir, "v_imports").select("repo", "file", "module").distinct()
    g = i.groupBy("repo", "file").agg(F.array_join(F.array_sort(F.collect_set(F.concat("module", F.lit('>=1 # "no"')))), "\n").alias("content"))
    return code.declared_deps(g.select("repo", F.concat(F.lit("src/requirements-"), F.regexp_extract("file", "([0-9]+)", 1), F.lit(".txt")).alias("path"), "content"))


@query("SELECT repo, file, module, line FROM (SELECT repo, file, module, row_number() OVER (PARTITION BY repo, file ORDER BY module) + 1 AS line FROM (SELECT DISTINCT repo, file, module FROM v_imports))", "v_imports")
def python_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = view(spark, sf_dir, "v_imports").select("repo", "file", "module").distinct()
    g = i.groupBy("repo", F.col("file").alias("path")).agg(F.concat(F.lit("from __future__ import annotations\n"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("import "), "module"))), "\n")).alias("content"))
    return code.imports_of_python(g).withColumn("line", F.col("line").cast("long"))


@query("SELECT repo, file, symbol, CAST((row_number() OVER (PARTITION BY repo, file ORDER BY symbol) - 1) * 4 + 1 AS INT) AS start_line, CAST(row_number() OVER (PARTITION BY repo, file ORDER BY symbol) * 4 AS INT) AS end_line, CASE WHEN cc > 25 THEN 3 ELSE 2 END AS cc FROM v_functions", "v_functions")
def python_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "v_functions")
    body = F.format_string("def %s(x):\n    if x%s:\n        return 1\n    return 2", "symbol", F.when(F.col("cc") > 25, F.lit(" and x > 1")).otherwise(""))
    g = f.groupBy("repo", F.col("file").alias("path")).agg(F.array_join(F.array_sort(F.collect_list(body)), "\n").alias("content"))
    return code.functions(g)


@query(
    """SELECT repo, 'test_value.weakening' AS rule, 'warning' AS severity, CASE WHEN k = 3 THEN 'src/o' ELSE 'tests/o' END || pos || '.rs' AS file, CAST(CASE k WHEN 3 THEN 40 WHEN 5 THEN 1 ELSE 7 END AS INT) AS line, kind FROM (
    SELECT repo, pos, k, unnest(CASE k WHEN 0 THEN ['assert_loosened'] WHEN 1 THEN ['assert_loosened', 'assert_loosened'] WHEN 2 THEN ['test_removed', 'test_removed', 'test_removed', 'assertion_removed']
      WHEN 3 THEN ['ignore_added', 'should_panic_added'] WHEN 5 THEN ['test_file_deleted'] ELSE [] END) AS kind FROM (SELECT repo, pos, pos % 6 AS k, summary FROM v_mutants) WHERE summary <> 'Timeout' OR k = 3)""",
    "v_mutants",
)
def weakened_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch per order that changes a source file, of Rust but for timed-out ones, and in one of six ways a test: a
    loose assertion, one on contents, tests and an assertion that go, test code in a source file, an assertion of
    product code that goes (no finding), a test file that goes."""
    m = view(spark, sf_dir, "v_mutants")
    body = [
        "@@ -5,2 +7,2 @@ fn t() {\n-    assert_eq!(f(), 1);\n+    assert!(f() > 0);\n",
        '@@ -5,2 +7,2 @@ fn t() {\n-    assert_eq!(f(), "one");\n+    assert!(f().contains("one"));\n',
        "@@ -5,6 +7,2 @@\n-#[test]\n-fn test_one() {\n-    assert_matches!(f(), One);\n-}\n-#[test]\n fn two() {\n",
        "@@ -38,2 +40,4 @@ mod tests {\n mod tests {\n+#[ignore]\n+#[should_panic(expected = 1)]\n",
        "@@ -5,2 +7,1 @@\n-    debug_assert!(x);\n fn run() {\n",
        "@@ -1,2 +0,0 @@\n-#[test]\n-fn test_gone() {}\n",
    ]
    k, n = F.col("pos") % 6, F.col("pos").cast("string")
    hunk = F.element_at(F.array(*[F.lit(x) for x in body]), (k + 1).cast("int"))
    product = F.concat(F.lit("src/p"), n, F.when(F.col("summary") == "Timeout", ".py").otherwise(".rs"))
    other = F.concat(F.when(k.isin(3, 4), "src/o").otherwise("tests/o"), n, F.lit(".rs"))
    # where nothing else is Rust, the file of the fifth way is none either
    other = F.when((k == 4) & (F.col("summary") == "Timeout"), F.concat(F.lit("src/o"), n, F.lit(".c"))).otherwise(other)
    head = lambda path, new: F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ "), new, F.lit("\n"))
    at = lambda path: F.concat(F.lit("b/"), path)
    text = F.concat(head(product, at(product)), F.lit("@@ -1 +1 @@\n-old\n+new\n"), head(other, F.when(k == 5, "/dev/null").otherwise(at(other))), hunk)
    patches = m.select("repo", n.alias("patch"), text.alias("text"))
    return diffs.weakening(diffs.parse_diffs(patches)).select("repo", "rule", "severity", "file", F.col("line").cast("int").alias("line"), "kind")


@query(
    """SELECT repo, path, min(line) AS first, max(line) + 1 AS last FROM (SELECT *, sum(apart) OVER (PARTITION BY repo, path ORDER BY line) AS n FROM (
    SELECT repo, report_path AS path, line, CASE WHEN line - lag(line) OVER (PARTITION BY repo, report_path ORDER BY line) <= 2 THEN 0 ELSE 1 END AS apart FROM v_cov_lines)) GROUP BY repo, path, n""",
    "v_cov_lines",
)
def changed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunks of two lines each; those that meet or touch are one range."""
    r = _reports(spark, sf_dir, F.concat(F.lit("--- a/x\n+++ b/"), "report_path", F.lit("\n")), F.format_string("@@ -1,1 +%d,2 @@ f\n+a\n b\n@@ -9 +7,0 @@", "line"), "\n", "\n")
    return diffs.changed_ranges(r.withColumnRenamed("report", "patch"))


@query(
    """SELECT repo, 't::' || id AS name, CASE WHEN start_line % 3 = 0 THEN CASE WHEN start_line % 2 = 0 THEN 'tests/t.rs' ELSE '.' END ELSE 'src/' || id || '.rs' END AS at_file,
    CAST(CASE WHEN start_line % 3 = 0 THEN CASE WHEN start_line % 2 = 0 THEN 7 END ELSE start_line END AS INT) AS at_line, CASE WHEN start_line % 3 = 0 THEN '/rustc/' || id || '.rs' ELSE 'src/' || id || '.rs' END || ':' || start_line AS panic_at FROM v_findings WHERE engine = 'tests'""",
    "v_findings",
)
def panic_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third failure panics outside the project; half of those have a test function of their name."""
    f = view(spark, sf_dir, "v_findings").where("engine = 'tests'")
    outside = F.col("start_line") % 3 == 0
    failures = f.select("repo", F.concat(F.lit("t::"), "id").alias("name"), F.col("message").alias("detail"), F.concat(F.when(outside, "/rustc/").otherwise("src/"), "id", F.lit(".rs")).alias("file"), "start_line")
    tests = f.where("start_line % 6 = 0").select("repo", F.lit("tests/t.rs").alias("file"), F.col("id").alias("symbol"), F.lit(7).alias("start_line"))
    return logs.attribute_panics(failures, tests).select("repo", "name", "at_file", "at_line", "panic_at")


def _rust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Rust file per order: an import of its own, one that is built in, one of its own module, and public items."""
    m = view(spark, sf_dir, "v_mutants")
    text = F.format_string("use k%d::a::b;\npub use std::fmt;\nuse inner::x;\nextern crate e%d;\nmod inner;\npub async fn run_%d() {}\npub struct S%d;\nfn own() {}\n", "pos", "pos", "pos", "pos")
    return m.select("repo", F.concat(F.lit("src/o"), F.col("pos").cast("string"), F.lit(".rs")).alias("path"), text.alias("content"))


@query("SELECT repo, 'src/o' || pos || '.rs' AS file, 'k' || pos AS module, 1 AS line FROM v_mutants UNION ALL SELECT repo, 'src/o' || pos || '.rs', 'e' || pos, 4 FROM v_mutants", "v_mutants")
def rust_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.imports_of_rust(_rust(spark, sf_dir))


@query("SELECT repo, 'src/o' || pos || '.rs' AS file, 'fn' AS kind, 'run_' || pos AS name FROM v_mutants UNION ALL SELECT repo, 'src/o' || pos || '.rs', 'struct', 'S' || pos FROM v_mutants", "v_mutants")
def rust_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.pub_items(_rust(spark, sf_dir))


@query(
    "SELECT repo, 'bin/o' || pos || '.sh' AS file, 'go_' || pos AS symbol, 2 AS start_line, 5 AS end_line, CASE WHEN summary = 'Timeout' THEN 4 ELSE 2 END AS cc FROM v_mutants UNION ALL SELECT repo, 'bin/o' || pos || '.sh', 'last', 6, 8, 1 FROM v_mutants",
    "v_mutants",
)
def shell_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "v_mutants")
    more = F.when(F.col("summary") == "Timeout", F.lit("  a && b || c # && no\n")).otherwise(F.lit("  a\n"))
    text = F.concat(F.format_string("#!/bin/sh\ngo_%d() {\n  if x; then y; fi\n", "pos"), more, F.lit("}\nfunction last {\n  z\n}\n"))
    return code.shell_functions(m.select("repo", F.concat(F.lit("bin/o"), F.col("pos").cast("string"), F.lit(".sh")).alias("path"), text.alias("content")))


@query(
    """SELECT DISTINCT repo, 'd' || pos AS dir, unnest(CASE pos % 4 WHEN 0 THEN ['a_' || pos, 'b'] WHEN 1 THEN ['c_d', 'e' || pos] WHEN 2 THEN ['f' || pos] ELSE ['g_h', 'i' || pos] END) AS module FROM v_mutants""",
    "v_mutants",
)
def declared_in_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cargo, pyproject, setup.cfg and setup.py manifests, one per order."""
    m = view(spark, sf_dir, "v_mutants")
    k, n = F.col("pos") % 4, F.col("pos").cast("string")
    cargo = F.concat(F.lit('[package]\nname = "x"\n[dependencies]\na-'), n, F.lit(' = "1"\n[dev-dependencies.b]\nversion = "2"\n'))
    pyproject = F.concat(F.lit('[project]\ndependencies = ["c-d>=1", "e'), n, F.lit('"]\n'))
    cfg = F.concat(F.lit("[metadata]\nname = x\n[options]\ninstall_requires =\n    f"), n, F.lit("<2\n"))
    setup = F.concat(F.lit('setup(install_requires=["g-h", "i'), n, F.lit('"],\n)\n'))
    text = F.when(k == 0, cargo).when(k == 1, pyproject).when(k == 2, cfg).otherwise(setup)
    name = F.when(k == 0, "Cargo.toml").when(k == 1, "pyproject.toml").when(k == 2, "setup.cfg").otherwise("setup.py")
    return code.declared_deps(m.select("repo", F.concat(F.lit("d"), n, F.lit("/"), name).alias("path"), text.alias("content")))


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Rust test file per order, with attributes that name a test and some that name none."""
    m = view(spark, sf_dir, "v_mutants")
    texts = [
        "#[test]\nfn t_%d() { run_%d(); }\n",
        "mod tests {\n    #[test]\n    #[ignore]\n\n    // why\n    fn t_%d() {\n        run_%d()\n    }\n}\n",
        "#[test]\n\n\n\n\nfn late_%d() { run_%d() }\n",
        "#[test]\nlet x = 1;\nfn no() {}\n#[test(threads = 2)]\nfn t_%d() { run_%d() }\n#[test]\npub fn hidden() {}\n",
    ]
    text = F.element_at(F.array(*[F.format_string(t, "pos", "pos") for t in texts]), (F.col("pos") % 4 + 1).cast("int"))
    return m.select("repo", "pos", F.concat(F.lit("tests/o"), F.col("pos").cast("string"), F.lit(".rs")).alias("path"), text.alias("content"))


@query("SELECT repo, 'tests/o' || pos || '.rs' AS file, 't_' || pos AS symbol, CAST(CASE pos % 4 WHEN 0 THEN 2 WHEN 1 THEN 6 ELSE 5 END AS INT) AS start_line FROM v_mutants WHERE pos % 4 <> 2", "v_mutants")
def test_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.test_functions(_tests(spark, sf_dir))


@query(
    """SELECT repo, count(*) > 8 AS every, CASE WHEN count(*) > 8 THEN '' ELSE string_agg('t_' || pos, ',' ORDER BY 't_' || pos) END AS tests FROM (
    SELECT *, row_number() OVER (PARTITION BY repo ORDER BY pos) AS n FROM v_mutants WHERE pos % 4 <> 2 AND summary <> 'Timeout') WHERE n <= CASE WHEN repo = 'r3' THEN 9 ELSE 8 END GROUP BY repo""",
    "v_mutants",
)
def targeted_rust_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests that the files themselves hold, for the functions that the first eight or nine orders of a repository changed."""
    files = _tests(spark, sf_dir)
    w = Window.partitionBy("repo").orderBy("pos")
    first = view(spark, sf_dir, "v_mutants").where("pos % 4 <> 2 and summary <> 'Timeout'").withColumn("n", F.row_number().over(w)).where(F.col("n") <= F.when(F.col("repo") == "r3", 9).otherwise(8))
    out = text.targeted_tests(files.drop("pos"), first.select("repo", F.format_string("m::run_%d", "pos").alias("symbol")))
    return out.select("repo", (F.size("tests") == 0).alias("every"), F.array_join("tests", ",").alias("tests"))


@query(
    """SELECT repo, 'src/o' || pos || CASE k WHEN 0 THEN '.rs' WHEN 1 THEN '.go' WHEN 2 THEN '.java' WHEN 3 THEN '.php' ELSE '.cpp' END AS file, CASE k WHEN 4 THEN 'f_' || pos WHEN 1 THEN 'F' || pos ELSE 'f' || pos END AS symbol,
    CAST(CASE k WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 1 END AS INT) AS start_line, CAST(CASE k WHEN 0 THEN 6 WHEN 1 THEN 6 WHEN 2 THEN 9 WHEN 3 THEN 11 ELSE 6 END AS INT) AS end_line, CAST(CASE k WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE 4 END AS INT) AS cc FROM (SELECT *, pos % 5 AS k FROM v_mutants)""",
    "v_mutants",
)
def brace_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file per order in Rust, Go, Java, PHP or C++, with braces and decisions in texts, characters and comments."""
    texts = [
        "pub fn f%d<'a>(x: &'a str) -> &'static str {\n    if x == \"if {\" { /* } /* if */ } */ }\n    let c = '{'; let q = '\\''; if c != q {}\n    let r = r#\"\" } if \"#;\n    match r { _ if c == 'x' => x, _ => \"\\u{7d}\" }\n}\n",
        "func (t *T) F%d(n int) int {\n\ts := `if {\n }`\n\tif n > 1 && s != \"{\" { // {\n\t\treturn '}' }\n\treturn 2 }\n",
        'class A {\n  public int f%d(int n) {\n    String s = """\n      if (a) { "x"\n      """;\n    if (n > 1) { return \'{\'; }\n    for (;;) { /* { */ }\n    // }\n  }\n}\n',
        "<?php\nfunction f%d($n) {\n  # if {\n  $s = <<<END\n if { \" '\n END;\n  $t = 'a\n}';\n  foreach ($n as $x) { while ($x) { } }\n  if ($t) { } #[Attr]\n}\n",
        "static int f_%d(int n) {\n  int k = 1'000'000;\n  auto s = R\"x(if { )\" )x\";\n  if (n > k || n == '{') { return 1; }\n  while (n) { /* { */ n--; }\n}\n",
    ]
    k = (F.col("pos") % 5 + 1).cast("int")
    m = view(spark, sf_dir, "v_mutants")
    ending = F.element_at(F.array(*[F.lit(x) for x in (".rs", ".go", ".java", ".php", ".cpp")]), k)
    return code.functions(m.select("repo", F.concat(F.lit("src/o"), F.col("pos").cast("string"), ending).alias("path"), F.element_at(F.array(*[F.format_string(t, "pos") for t in texts]), k).alias("content")))


LINEAR = "(CASE WHEN v / 255.0::DOUBLE <= 0.04045 THEN v / 255.0::DOUBLE / 12.92 ELSE pow((v / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"


@query(
    f"""SELECT repo, file, symbol, 'some-' || symbol || '-' || cc AS pep, 'a::' || symbol || '::go' AS plain, 'T' || symbol || '::go' AS cast_name, 'a::' || symbol AS prefix, '<' || symbol || '&' AS attr, cc * 2 || '%' AS share,
    CASE WHEN length(repeat(symbol, cc)) <= 20 THEN repeat(symbol, cc) ELSE left(repeat(symbol, cc), 17) || '…' END AS cut, symbol || ' ' || cc AS brief, round(1.05 / ({LINEAR} * 0.2126 + {LINEAR} * 0.7152 + {LINEAR} * 0.0722 + 0.05), 6) AS contrast
    FROM (SELECT *, cc * 5 AS v FROM v_functions)""",
    "v_functions",
)
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column expressions over names, tags, texts and colours, on texts made of functions' names."""
    s, n = F.col("symbol"), F.col("cc").cast("string")
    shade = F.lower(F.lpad(F.hex(F.col("cc") * 5), 2, "0"))
    return view(spark, sf_dir, "v_functions").select(
        "repo", "file", "symbol", scoring.pep503(F.concat(F.lit("  Some_"), s, F.lit(".-"), n, F.lit(" "))).alias("pep"), scoring.symbol_name(F.concat(F.lit("a::"), s, F.lit("[1f]::go"))).alias("plain"),
        scoring.symbol_name(F.concat(F.lit("<T"), s, F.lit(" as Visit>::go"))).alias("cast_name"), scoring.module_prefix(F.concat(F.lit("crates/x/src/a/"), s, F.lit(".rs"))).alias("prefix"), scoring.xml_attr(F.concat(F.lit('line name="&lt;'), s, F.lit('&amp;" x="1"')), "name").alias("attr"),
        scoring.percent(F.col("cc") / 50).alias("share"), scoring.truncate_bytes(F.repeat(s, F.col("cc")), 20).alias("cut"), scoring.brief(F.concat(F.lit(" "), s, F.lit("\n\n  "), n, F.lit(" "))).alias("brief"),
        F.round(scoring.contrast(scoring.color(F.lit("#fff")), scoring.color(F.concat(F.lit("#"), shade, shade, shade))), 6).alias("contrast"),
    )
