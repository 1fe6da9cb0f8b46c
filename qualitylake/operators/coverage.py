"""Coverage joined to functions, and the CRAP family: complexity against coverage.

functions: repo, file, symbol, start_line, end_line, cc. cov_lines: repo, report_path, line, hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths, scoring


def own_paths(report_paths: DataFrame, files: DataFrame) -> DataFrame:
    """repo, report_path and file: the project file that a path of a coverage report means.

    The longest file that the path equals or ends with (behind a slash); else the only file that ends with the
    path; else the only file of that name. Distinct paths are resolved once, by equi-joins on whole suffixes: a
    common file name such as `index.js` makes no group, as suffixes hold the directories, too."""
    p = report_paths.select("repo", "report_path").distinct().withColumn("norm", paths.normalize("report_path"))
    f = files.select("repo", "file").distinct()

    def suffixes(path: str) -> Column:
        parts = F.split(path, "/")
        return F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")))

    # of each suffix: whether it is a file, and how many files are longer or have it for a name, with the least of each
    ends = f.select("repo", "file", suffixes("file").alias("end"))
    whole, named = F.col("end") == F.col("file"), F.col("end") == paths.basename("file")
    met = ends.groupBy("repo", "end").agg(F.max(whole).alias("whole"), F.count_if(~whole).alias("n_longer"), F.min(F.when(~whole, F.col("file"))).alias("longer"), F.count_if(named).alias("n_named"), F.min(F.when(named, F.col("file"))).alias("named"))
    j = p.select("repo", "report_path", "norm", suffixes("norm").alias("end")).join(met, ["repo", "end"])
    full, base = F.col("end") == F.col("norm"), F.col("end") == paths.basename("norm")
    g = j.groupBy("repo", "report_path").agg(
        F.max_by("end", F.when(F.col("whole"), F.length("end"))).alias("whole"),
        F.max(F.when(full, F.col("n_longer"))).alias("n_longer"), F.max(F.when(full, F.col("longer"))).alias("longer"),
        F.max(F.when(base, F.col("n_named"))).alias("n_named"), F.max(F.when(base, F.col("named"))).alias("named"),
    )
    n_longer = F.coalesce("n_longer", F.lit(0))
    owner = F.when(F.col("whole").isNotNull(), F.col("whole")).when(n_longer == 1, F.col("longer")).when((n_longer == 0) & (F.col("n_named") == 1), F.col("named"))
    return g.select("repo", "report_path", owner.alias("file")).where("file is not null")


def function_coverage(functions: DataFrame, cov_lines: DataFrame, band: int = 512) -> DataFrame:
    """repo, file, symbol, covered, lines and coverage of the functions that have coverage lines.

    cov_lines: repo, file, line, hits. A range join: lines meet functions by file and by band of `band` lines, so a
    giant file spreads over many keys; functions stand in every band that they touch. Of functions that share a
    file and symbol the one that starts first counts."""
    w = Window.partitionBy("repo", "file", "symbol").orderBy("start_line", "end_line")
    first = functions.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    banded = first.select("repo", "file", "symbol", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / band), F.floor(F.greatest("start_line", "end_line") / band))).alias("_band"))
    lines = cov_lines.groupBy("repo", "file", "line").agg(F.max("hits").alias("hits")).withColumn("_band", F.floor(F.col("line") / band))
    met = banded.join(lines, ["repo", "file", "_band"]).where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    counted = met.groupBy("repo", "file", "symbol").agg(F.count_if(F.col("hits") > 0).alias("covered"), F.count("*").alias("lines"))
    return counted.withColumn("coverage", F.col("covered") / F.col("lines"))


def match_symbols(functions: DataFrame, cov_functions: DataFrame) -> DataFrame:
    """Functions with the coverage of the record that names them: shortest extra path first, an exact name over
    one without its crate, then the largest coverage.

    cov_functions: repo, file (owner), prefix (how much longer the report's path is), name, coverage."""
    exact = cov_functions.withColumn("symbol", F.col("name")).withColumn("rank", F.lit(0))
    stripped = cov_functions.withColumn("symbol", scoring.without_crate("name")).withColumn("rank", F.lit(1)).where(F.col("symbol") != F.col("name"))
    w = Window.partitionBy("repo", "file", "symbol").orderBy("prefix", "rank", F.desc("coverage"))
    best = exact.unionByName(stripped).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("repo", "file", "symbol", "coverage", (F.col("rank") == 0).alias("exact"))
    return functions.join(best, ["repo", "file", "symbol"])


def unmatched(functions: DataFrame, cov: DataFrame) -> DataFrame:
    return functions.join(cov, ["repo", "file", "symbol"], "left_anti")


def score_functions(functions: DataFrame, cov: DataFrame) -> DataFrame:
    """Functions with a coverage record, with their CRAP; without one there is no score."""
    return functions.join(cov.select("repo", "file", "symbol", "coverage"), ["repo", "file", "symbol"]).withColumn("crap", scoring.crap_score("cc", "coverage"))


def over_threshold(scored: DataFrame, threshold: int = 30) -> DataFrame:
    return scored.where(F.col("crap") > threshold)


def untested(scored: DataFrame, least: int = 5) -> DataFrame:
    return scored.where((F.col("cc") >= least) & (F.col("coverage") == 0))


def worst(scored: DataFrame, n: int = 10) -> DataFrame:
    """The functions of highest CRAP per repo; of rows that share file and symbol the worst counts for each."""
    w = Window.partitionBy("repo").orderBy(F.desc("crap"), "file", "symbol")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def crap_summary(functions: DataFrame, cov: DataFrame, threshold: int = 30, least: int = 5) -> DataFrame:
    """Per repo: crap_max, functions over the threshold, untested ones, without coverage, and completeness."""
    joined = functions.join(cov.select("repo", "file", "symbol", "coverage"), ["repo", "file", "symbol"], "left").withColumn("crap", scoring.crap_score("cc", "coverage"))
    return joined.groupBy("repo").agg(
        F.coalesce(F.max("crap"), F.lit(0.0)).alias("crap_max"),
        F.count_if(F.col("crap") > threshold).alias("over"),
        F.count_if((F.col("cc") >= least) & (F.col("coverage") == 0)).alias("untested"),
        F.count_if(F.col("coverage").isNull()).alias("unmatched"),
        F.bool_and(F.col("coverage").isNotNull()).alias("coverage_complete"),
    )


def crap_gate(summary: DataFrame, enforce: bool = True) -> DataFrame:
    """A gate per repo: fails on functions over the threshold; incomplete coverage without failures is advisory, with
    failures a note behind them. A failing gate that isn't enforced says so."""

    def some(n: str, noun: str) -> Column:
        return F.concat_ws(" ", F.col(n).cast("string"), F.when(F.col(n) == 1, noun).otherwise(noun + "s"))

    failed = (F.col("over") > 0) | (F.col("untested") > 0)
    missing = F.when(~F.col("coverage_complete"), F.concat(some("unmatched", "function"), F.lit(" without coverage")))
    faults = F.concat_ws(", ", F.when(F.col("over") > 0, F.concat(some("over", "function"), F.lit(" over the threshold"))), F.when(F.col("untested") > 0, F.concat(some("untested", "complex function"), F.lit(" untested"))))
    text = F.when(failed, F.concat(F.concat_ws("; ", faults, missing), F.lit("" if enforce else " (advisory)"))).otherwise(missing)
    return summary.select("repo", F.lit("crap").alias("id"), (~failed & F.col("coverage_complete")).alias("pass"), (F.lit(enforce) & (failed | F.col("coverage_complete"))).alias("enforced"), text.alias("reason"))


def crap_findings(scored: DataFrame, threshold: int = 30, least: int = 5) -> DataFrame:
    """`crap.over_threshold` and `complexity.untested` rows, both errors."""
    number = F.format_string("%.0f", "crap")
    over = over_threshold(scored, threshold).withColumn("rule", F.lit("crap.over_threshold")).withColumn("message", F.concat(F.lit("CRAP "), number, F.lit(" (CC="), F.col("cc").cast("string"), F.lit(", cov="), scoring.percent("coverage"), F.lit(f") exceeds threshold {threshold}")))
    none = untested(scored, least).withColumn("rule", F.lit("complexity.untested")).withColumn("message", F.concat(F.lit("CC="), F.col("cc").cast("string"), F.lit(" without any covered line")))
    return over.unionByName(none).select("repo", "rule", F.lit("crap").alias("engine"), F.lit("error").alias("severity"), "file", "start_line", "symbol", "message")


def unmatched_finding(missing: DataFrame, show: int = 20) -> DataFrame:
    """One warning per repo with functions that no coverage record names: how many, and the first of them."""
    w = Window.partitionBy("repo").orderBy("file", "symbol", "start_line")
    placed = missing.withColumn("_n", F.row_number().over(w))
    g = placed.groupBy("repo").agg(F.count("*").alias("total"), F.array_sort(F.collect_list(F.when(F.col("_n") <= show, F.struct("_n", F.concat_ws("::", "file", "symbol").alias("name"))))).alias("first"))
    names = F.array_join(F.transform("first", lambda x: x["name"]), ", ")
    message = F.when(F.col("total") == 1, F.concat(names, F.lit(" has no coverage record"))).otherwise(F.concat(F.col("total").cast("string"), F.lit(" functions have no coverage record")))
    return g.select("repo", F.lit("coverage.unmatched").alias("rule"), F.lit("warning").alias("severity"), "total", message.alias("message"), names.alias("functions"))


def line_rate(cov: DataFrame) -> DataFrame:
    """Mean coverage of the functions, and covered lines of all lines."""
    return cov.groupBy("repo").agg(F.avg("coverage").alias("function_rate"), (F.sum("covered") / F.sum("lines")).alias("line_rate"))


def scope_metrics(files: DataFrame, functions: DataFrame, cov: DataFrame) -> DataFrame:
    """Files and lines in scope, functions, and the mean coverage of those functions (null without any).

    files: repo, path, loc."""
    f = files.groupBy("repo").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))
    joined = functions.join(cov.select("repo", "file", "symbol", "coverage"), ["repo", "file", "symbol"], "left")
    g = joined.groupBy("repo").agg(F.count("*").alias("functions"), F.avg("coverage").alias("coverage_changed"))
    return f.join(g, "repo", "left").select("repo", "files", "loc", F.coalesce("functions", F.lit(0)).alias("functions"), "coverage_changed")


def merge_metrics(metrics: DataFrame) -> DataFrame:
    """Metrics of several roots of a repo: counts and coverage_changed are summed, crap_max is the largest.

    coverage_changed is a sum of fractions by definition, so it may exceed 1."""
    return metrics.groupBy("repo").agg(F.sum("files").alias("files"), F.sum("loc").alias("loc"), F.sum("functions").alias("functions"), F.sum("coverage_changed").alias("coverage_changed"), F.max("crap_max").alias("crap_max"))


def coverage_missing(repos: DataFrame, functions: DataFrame, gates: DataFrame, runs: DataFrame, cov: DataFrame) -> DataFrame:
    """A `coverage.missing` warning with its reason for each repo with functions that no coverage record names.

    repos: repo, coverage_enabled, has_suite. runs: repo, engine, pos, exit_code. A repo without any record may
    have failing tests: then the last failing run's exit code is the reason, if it has one, else the gate's own."""
    tests = gates.where(F.col("id") == "tests").groupBy("repo").agg(F.bool_and("pass").alias("tests_pass"), F.min("reason").alias("said"))
    last = runs.where((F.col("engine") == "tests") & ~F.col("exit_code").eqNullSafe(0)).groupBy("repo").agg(F.max_by("exit_code", "pos").alias("code"))
    joined = functions.select("repo", "file", "symbol").join(cov.select("repo", "file", "symbol", F.lit(True).alias("_has")), ["repo", "file", "symbol"], "left")
    counted = joined.groupBy("repo").agg(F.count_if(F.col("_has").isNull()).alias("n"), F.bool_and(F.col("_has").isNull()).alias("none"))
    r = repos.join(counted, "repo").where("n > 0").join(tests, "repo", "left").join(last, "repo", "left")
    failed = F.col("none") & ~F.coalesce("tests_pass", F.lit(True))
    why = F.when(F.col("code").isNotNull(), F.format_string("exit code %d", "code")).otherwise(F.coalesce("said", F.lit("no test command was run")))
    hint = F.when(~F.col("coverage_enabled"), "coverage is disabled").when(~F.col("has_suite"), "no test suite was found").when(F.col("none"), "no coverage report was written").otherwise("the report leaves them out")
    count = F.concat_ws(" ", F.lit("no coverage data for"), F.col("n").cast("string"), F.when(F.col("n") == 1, "function").otherwise("functions"))
    reason = F.when(failed, F.concat(F.lit("tests failed: "), why)).otherwise(F.concat(count, F.lit(": "), hint))
    return r.select("repo", F.lit("coverage.missing").alias("rule"), F.lit("warning").alias("severity"), reason.alias("reason"))


def source_dirs(functions: DataFrame) -> DataFrame:
    """Directories that hold functions; `.` for the root, and for repos without any."""
    d = paths.dirname("file")
    return functions.select("repo", F.when((d == "") | d.isNull(), ".").otherwise(d).alias("dir")).distinct()


def mutation_summary(mutants: DataFrame, timeouts: bool = True) -> DataFrame:
    """Counts and score of mutants: killed of all that were decided, null if none was.

    A single run counts timeouts as not killed; a merge of several roots leaves them out (`timeouts=False`)."""
    s = F.lower("summary")
    g = mutants.groupBy("repo").agg(F.count_if(s == "caughtmutant").alias("killed"), F.count_if(s == "missedmutant").alias("survived"), F.count_if(s == "timeout").alias("timeout"), F.count_if(s == "unviable").alias("unviable"))
    total = F.col("killed") + F.col("survived") + (F.col("timeout") if timeouts else F.lit(0))
    return g.withColumn("score", F.try_divide(F.col("killed").cast("double"), total))


def survivor_findings(mutants: DataFrame) -> DataFrame:
    return mutants.where(F.lower("summary") == "missedmutant").select("repo", F.lit("mutation.survived").alias("rule"), F.lit("warning").alias("severity"), "file", "pos")


def test_value(mutation: DataFrame, weakening: DataFrame) -> DataFrame:
    """Per repo how much of the check of its tests' worth ran: ran where both parts did, partial where a part was
    skipped or went wrong, skipped where neither ran or went wrong; and the score and findings of the parts.

    mutation: repo, status (ran, skipped, or anything else that went wrong), score; weakening: repo, status, findings.
    A repo that one of them lacks counts as skipped there."""
    joined = mutation.select("repo", F.coalesce("status", F.lit("skipped")).alias("m"), "score").join(weakening.select("repo", F.coalesce("status", F.lit("skipped")).alias("w"), "findings"), "repo", "full_outer")
    parts = [F.coalesce(c, F.lit("skipped")) for c in ("m", "w")]
    idle = [(p == "skipped").cast("int") for p in parts]
    ran = [(p == "ran").cast("int") for p in parts]
    status = F.when(ran[0] + ran[1] == 2, "ran").when(idle[0] + idle[1] == 2, "skipped").otherwise("partial")
    return joined.select("repo", "score", F.coalesce("findings", F.lit(0)).alias("findings"), status.alias("status"))
