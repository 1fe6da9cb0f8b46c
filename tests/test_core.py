"""Scores, fingerprints, paths, joins and history on fixed values and small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from qualitylake.functions import paths, scoring
from qualitylake.operators import coverage, findings, history, scope


def one(spark, column, **values):
    """A column expression over one row of values."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_golden_fingerprint(spark):
    want = "1a79e6f63cf6ee2917d8dec10245dbce2ebb09e93f55f115fa2823a1883ea1ff"
    message = "CRAP 156 (CC=12, cov=0%) exceeds threshold 30"
    for file, text in (("src/parse.rs", message), (".\\src//parse.rs", f"  {message.replace(' ', '  ')}\n")):
        assert one(spark, scoring.fingerprint(), rule="crap.over_threshold", file=file, symbol="parse_input", message=text) == want
    assert one(spark, scoring.fingerprint(), rule="crap.over_threshold", file="src/other.rs", symbol="parse_input", message=message) != want


@pytest.mark.parametrize("value, score, grade", [(1.0, 100, "A"), (0.9, 90, "A"), (0.895, 90, "A"), (0.894, 89, "B"), (0.795, 80, "B"), (0.794, 79, "C"), (0.695, 70, "C"), (0.694, 69, "D"), (0.595, 60, "D"), (0.594, 59, "F"), (0.575, 58, "F"), (0.0, 0, "F"), (1.1, None, None), (-0.1, None, None)])
def test_grades(spark, value, score, grade):
    names = list("abcde")
    row = spark.range(1).select(*[F.lit(value).alias(n) for n in names]).select(scoring.overall(names).alias("s")).select("s", scoring.grade("s")).first()
    assert tuple(row) == (score, grade)


def test_uneven_scores(spark):
    for values, want in (((0.2, 0.4, 0.6, 0.8, 1.0), 60), ((0.125, 1.0, 1.0, 1.0, 1.0), 83), ((None, 1.0, 1.0, 1.0, 1.0), None)):
        cols = [F.lit(v).cast("double") for v in values]
        assert spark.range(1).select(scoring.overall(cols)).first()[0] == want


def test_crap(spark):
    for cc, cov, want in ((5, 0.0, 30.0), (12, 0.0, 156.0), (12, 1.0, 12.0), (12, 1.5, 12.0), (3, -1.0, 12.0)):
        assert one(spark, scoring.crap_score("cc", "cov"), cc=cc, cov=cov) == want
    assert one(spark, scoring.crap_score(F.lit(3), F.lit(None).cast("double")), x=1) is None
    scored = spark.createDataFrame([("r", "f", "a", 5, 0.0, 30.0), ("r", "f", "b", 12, 0.0, 156.0)], "repo string, file string, symbol string, cc int, coverage double, crap double")
    assert [r["symbol"] for r in coverage.over_threshold(scored).collect()] == ["b"]


def test_globs(spark):
    for glob, path, hit in (("target/**", "src/target/lib.rs", True), ("target/**", "src/lib.rs", False), ("**/a/b/**", "x/a/b/c", True), ("a/b/**", "a/c/b", False), ("./src", "src/x", True), ("src", "srcs/x", False), (" ", "x", False), ("/**", "x", True), ("a.b/**", "axb/c", False)):
        assert one(spark, paths.matches_any("p", [glob]), p=path) is hit, glob
    assert one(spark, paths.matches_any("p", ["target/**"], anchored=True), p="src/target/x") is False
    assert one(spark, paths.matches_any("p", ["**/target/**"], anchored=True), p="src/target/x") is True


def test_paths(spark):
    for p, want in (("a/.git/x", True), ("target/x", True), ("a/target/x", False), (".x/y", True), (".cache/y", True), ("a/b.c", False), ("vendor", False)):
        assert one(spark, paths.in_skipped_dir("p"), p=p) is want, p
    assert one(spark, paths.in_skipped_dir("p", include=["vendor/**"]), p="vendor/a/x") is False
    for p, want in (("a/tests/x.py", True), ("x_test.go", True), ("a/FooTest.java", True), ("conftest.py", True), ("App.Tests/x.cs", True), ("tests", False), ("contest.py", False), ("a/x.spec.ts", True)):
        assert one(spark, paths.is_test_path("p"), p=p) is want, p
    for p, want in (("a.tsx", "node"), ("b.cc", "cpp"), ("c", None), (".py", None), ("d.PY", None)):
        assert one(spark, paths.language_of("p"), p=p) == want, p
    for v, want in ((" a.html?x#y ", "a.html"), ("#x", None), ("//h/x", None), ("HTTP://x", None), ("mailto:a", None), ("?q", None), ("", None), ("/r/s", "/r/s")):
        assert one(spark, paths.local_target("v"), v=v) == want, v
    for page, target, want in (("d/p.html", "../x/./y", "x/y"), ("p.html", "y", "y"), ("d/p.html", "/z", "z"), ("d/p.html", "../../../w", "w")):
        assert one(spark, paths.resolve("p", "t"), p=page, t=target) == want


def test_texts(spark):
    assert one(spark, scoring.truncate_bytes("t", 8), t="äöüß") == "äöüß"
    assert one(spark, scoring.truncate_bytes("t", 7), t="äöüß") == "äö…"
    assert one(spark, scoring.percent_encode("t"), t="a b/ü~*+.rs") == "a%20b/%C3%BC~%2A%2B.rs"
    assert one(spark, scoring.safe_line("t"), t=" a\x00b \t c　d ") == "a b c d"
    assert one(spark, scoring.brief("t"), t="\n a \n\nb\nc\nd\ne") == "a b c d"
    assert one(spark, scoring.pep503("t"), t=" A__b.-C ") == "a-b-c"
    for raw, want in (("a::b[12ab]::c", "a::b::c"), ("<Cc as Visit>::go", "Cc::go"), ("parse::<u8::from>", "parse"), ("<Foo<T>>::new", "Foo::new"), ("plain", "plain")):
        assert one(spark, scoring.symbol_name("t"), t=raw) == want, raw
    assert one(spark, scoring.xml_attr("t", "name"), t='method name="&lt;a&amp;lt;" x="1"') == "<a<"
    for path, want in (("crates/x/src/a/b.rs", "a::b"), ("src/lib.rs", ""), ("src/a/mod.rs", "a")):
        assert one(spark, scoring.module_prefix("t"), t=path) == want


def test_colors(spark):
    for text, want in (("#fff", [255, 255, 255]), (" #0A0b0C", [10, 11, 12]), ("rgb(1, 2,3)", [1, 2, 3]), ("Grey", [128, 128, 128]), ("rgb(1,2,300)", None), ("#ff", None), ("hotpink", None)):
        assert one(spark, scoring.color("t"), t=text) == want
    assert one(spark, scoring.contrast(scoring.color(F.lit("#fff")), scoring.color(F.lit("#000"))), t=1) == pytest.approx(21.0)


FINDING = "repo string, run_id string, id string, rule string, engine string, severity string, file string, start_line int, symbol string, message string, suggested_action string"


def finding(i, run="1", rule="x", engine="tests", severity="error", file="f", symbol=None, message=None):
    return ("r", run, f"i{i}", rule, engine, severity, file, 1, symbol, message or f"m{i}", None)


def test_scores_and_dispositions(spark):
    f = spark.createDataFrame([finding(1), finding(2, severity="warning"), finding(3, engine="sca", severity="warning"), finding(4, rule="coverage.missing", engine="crap"), *[finding(9 + k, engine="a11y") for k in range(9)]], FINDING)
    s = findings.scores(f, f).first()
    assert s["correctness"] == pytest.approx(0.7) and s["security"] == pytest.approx(0.99) and s["a11y"] == 0 and s["maintainability"] == s["efficiency"] == 1
    for rule, severity, want in (("sca.hallucinated_import", "error", "ask"), ("perf.x", "error", "ignore"), ("x", "warning", "ask"), ("x", "info", "fix")):
        assert one(spark, scoring.disposition(), rule=rule, severity=severity) == want


def test_trend(spark):
    rows = [finding(1, "1", message="a"), finding(2, "1", message="b"), finding(3, "2", message="b"), finding(4, "2", message="c")]
    f = spark.createDataFrame(rows, FINDING)
    t = history.trend(findings.scores(f, f), f, ["correctness"]).collect()
    assert [tuple(r) for r in t] == [("r", "2", "", 1, 1)]


def test_baseline_gates(spark):
    f = spark.createDataFrame([finding(1, message="old"), finding(2, engine="compile", message="new")], FINDING)
    gates = spark.createDataFrame([("r", "1", g, False, on, None) for g, on in (("tests", True), ("types", True), ("mutation", True), ("lint", False))], "repo string, run_id string, id string, pass boolean, enforced boolean, reason string")
    b = history.baseline_of(f.where("message = 'old'"))
    assert sorted(r["id"] for r in history.gates_failing_on_new(gates, f, b).collect()) == ["mutation", "types"]


def test_path_owners(spark):
    files = spark.createDataFrame([("r", p) for p in ("a.py", "x/a.py", "y/b.py", "z/b.py", "w/c.py", "d/e/f.py")], "repo string, file string")
    reports = spark.createDataFrame([("r", p) for p in ("/ci/x/a.py", "a.py", "b.py", "q/c.py", "e/f.py", "none.py")], "repo string, report_path string")
    got = {r["report_path"]: r["file"] for r in coverage.own_paths(reports, files).collect()}
    assert got == {"/ci/x/a.py": "x/a.py", "a.py": "a.py", "q/c.py": "w/c.py", "e/f.py": "d/e/f.py"}


def test_coverage_is_never_assumed(spark):
    functions = spark.createDataFrame([("r", "f", "a", 1, 9, 12), ("r", "f", "b", 20, 29, 12), ("r", "f", "giant", 100, 5000, 3)], "repo string, file string, symbol string, start_line int, end_line int, cc int")
    lines = spark.createDataFrame([("r", "f", 2, 1), ("r", "f", 3, 0), ("r", "f", 3, 0), ("r", "f", 600, 1), ("r", "f", 4999, 1)], "repo string, file string, line int, hits int")
    cov = coverage.function_coverage(functions, lines)
    assert {r["symbol"]: r["coverage"] for r in cov.collect()} == {"a": 0.5, "giant": 1.0}
    assert [r["symbol"] for r in coverage.unmatched(functions, cov).collect()] == ["b"]
    summary = coverage.crap_summary(functions, cov).first()
    assert (summary["over"], summary["unmatched"], summary["coverage_complete"]) == (0, 1, False)
    gate = coverage.crap_gate(coverage.crap_summary(functions, cov)).first()
    assert (gate["pass"], gate["enforced"], gate["reason"]) == (False, False, "1 function without coverage")


def test_incremental_roots_and_labels(spark):
    roots = spark.createDataFrame([("r", "a", "go"), ("r", "a/b", "go"), ("r", "a/c", "node"), ("r", ".", "node")], "repo string, root string, pack string")
    assert sorted(r["root"] for r in scope.independent_roots(roots).collect()) == [".", "a"]
    changed = spark.createDataFrame([("r", p) for p in "dabc"], "repo string, path string")
    assert scope.changed_paths_label(changed).first()["label"] == "a, b, c +1 more"


def test_test_value(spark):
    m = spark.createDataFrame([("a", "ran", 1.0), ("b", "ran", 0.5), ("c", "failed", None), ("e", "skipped", None), ("f", "skipped", None), ("g", "failed", None)], "repo string, status string, score double")
    w = spark.createDataFrame([("a", "ran", 2), ("b", "skipped", 0), ("d", "ran", 0), ("e", "skipped", None), ("g", "ran", 1)], "repo string, status string, findings int")
    assert {r["repo"]: r["status"] for r in coverage.test_value(m, w).collect()} == {"a": "ran", "b": "partial", "c": "partial", "d": "partial", "e": "skipped", "f": "skipped", "g": "partial"}


def test_gates_of_runs(spark):
    f = spark.createDataFrame([("r", "1", "secrets", "error", "secrets.x"), ("r", "1", "sca", "warning", "sca.x"), ("r", "1", "lint", "warning", "engine.unavailable"), ("r", "2", "lint", "warning", "lint.failed"), ("r", "2", "html", "warning", "html.x"), ("r", "2", "links", "warning", "links.missing")], "repo string, run_id string, engine string, severity string, rule string")
    runs = spark.createDataFrame([("r", "1"), ("r", "2"), ("r", "3")], "repo string, run_id string")
    on = {"secrets": True, "sca": False, "html": False, "links": False, "lint": True}
    gates = findings.count_gates(f, on, runs=runs, required=("lint",))
    failed = {(r["run_id"], r["id"]): r["reason"] for r in gates.where("not pass").collect()}
    late = " (advisory; does not fail the process)"
    assert gates.count() == 15 and failed == {("1", "secrets"): "1 secrets", ("1", "sca"): "1 undeclared dependencies" + late, ("1", "lint"): "lint unavailable", ("2", "lint"): "lint failed", ("2", "links"): "1 missing files" + late}
    assert {r["run_id"]: r["verdict_fails"] for r in findings.verdicts(gates).collect()} == {"1": True, "2": True, "3": False}
    none = findings.verdicts(gates.limit(0), runs=runs).collect()
    assert len(none) == 3 and not any(r["verdict_fails"] or r["exit_fails"] for r in none)


def test_trend_of_many_runs(spark):
    """A finding that comes and goes is new and resolved each time; one that stays is neither."""
    row = "repo string, run_id string, rule string, file string, symbol string, message string, engine string, severity string"
    rows = [("r", f"{n:03}", f"on{n % 3}", "a.py", None, "m", "tests", "error") for n in range(60)] * 2 + [("r", f"{n:03}", "stays", "a.py", None, "m", "tests", "error") for n in range(60)]
    f = spark.createDataFrame(rows, row)
    out = history.trend(findings.scores(f, f), f, ["correctness"]).collect()
    assert len(out) == 59 and {(r["new"], r["resolved"]) for r in out} == {(1, 1)}


def test_entries():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "worst_crap" in queries
    assert callable(entry.entry)


FOUND = "repo string, run_id string, id string, rule string, engine string, severity string, file string, start_line int, symbol string, message string, suggested_action string"
GATE = "repo string, run_id string, id string, pass boolean, enforced boolean, reason string"


def _found(spark, n):
    k = F.col("id")
    # two runs, the first with nine tenths of the findings; some rows repeat wholly
    f = spark.range(n).select(
        F.lit("r").alias("repo"), F.when(k % 10 == 0, "2").otherwise("1").alias("run_id"), (k % 17).cast("string").alias("id"), F.concat(F.lit("rule."), (k % 3).cast("string")).alias("rule"), F.lit("tests").alias("engine"), F.lit("error").alias("severity"),
        F.concat(F.lit("src/ü "), (k % 5).cast("string")).alias("file"), F.when(k % 4 > 0, (k % 7).cast("int")).alias("start_line"), F.when(k % 2 == 0, F.lit("s")).alias("symbol"), F.concat(F.lit('a "quoted", [text]\n'), (k % 11).cast("string")).alias("message"), F.lit(None).cast("string").alias("suggested_action"), F.lit(1).alias("key"), F.lit("x").alias("text"))
    return f.unionByName(f.where("message like '%\n3'"))


def test_documents_in_parts(spark):
    from qualitylake.operators import documents

    f, g = _found(spark, 500), spark.createDataFrame([("r", "1", "tests", False, True, "x"), ("r", "1", "a11y", True, False, None), ("r", "2", "tests", True, True, None), ("r", "3", "tests", True, True, None)], GATE)
    whole = {(r.repo, r.run_id): json.loads(r.sarif) for r in findings.to_sarif(f, g).collect()}
    for limit in (1, 700, 1 << 20):
        parts = documents.sarif_parts(f, g, limit=limit)
        assert parts.agg(F.max(F.octet_length("text"))).first()[0] < limit + 500
        got = {(r.repo, r.run_id): json.loads(r.text) for r in documents.joined(parts).collect()}
        assert set(got) == {("r", "1"), ("r", "2"), ("r", "3")}
        for run, d in got.items():
            a, b = d["runs"][0], whole[run]["runs"][0]
            assert a["results"] == b["results"] and a["tool"] == b["tool"], (run, limit)
            assert sorted(map(str, a["properties"]["gates"])) == sorted(map(str, b["properties"]["gates"]))
    # no tables, no rows; null runs and messages are kept
    assert documents.sarif_parts(spark.createDataFrame([], FOUND), spark.createDataFrame([], GATE)).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, "tests", "error", "a", None, None, None, None)], FOUND)
    one = documents.joined(documents.sarif_parts(odd, spark.createDataFrame([], GATE))).collect()
    assert len(one) == 1 and len(json.loads(one[0].text)["runs"][0]["results"]) == 1


def test_reports_in_parts(spark, tmp_path):
    from qualitylake.operators import documents
    from qualitylake.sources import reports

    f, g = _found(spark, 300), spark.createDataFrame([("r", "1", "tests", False, True, "x"), ("r", "2", "tests", True, None, None), ("r", "9", "tests", True, None, None)], GATE)
    runs = spark.createDataFrame([("r", "1", False), ("r", "2", False), ("r", "3", True)], "repo string, run_id string, analyzer_error boolean")
    ran = spark.createDataFrame([("r", "1", 0, "tests", 5), ("r", "1", 1, "lint", 7)], "repo string, run_id string, pos int, engine string, duration_ms long")
    parts = documents.report_parts(runs, g, f, ran, limit=600)
    read = {r.run_id: r for r in reports.parse_reports(documents.joined(parts, "report")).collect()}
    assert {k: (r.verdict, len(r.gates), len(r.findings), [x.engine for x in r.runs]) for k, r in read.items()} == {"1": ("fail", 1, f.where("run_id = '1'").count(), ["tests", "lint"]), "2": ("pass", 1, f.where("run_id = '2'").count(), []), "3": ("fail", 0, 0, [])}
    assert sorted((x.file, x.span.start_line, x.message) for x in read["2"].findings if x.span.start_line is not None) == sorted(map(tuple, f.where("run_id = '2' and start_line is not null").select("file", "start_line", "message").collect()))
    documents.write_parts(parts, f"file://{tmp_path}/out")
    folder = tmp_path / "out" / "repo=r" / "run_id=1"
    assert len(json.loads("".join(p.read_text() for p in sorted(folder.glob("part-*"))))["findings"]) == len(read["1"].findings)
