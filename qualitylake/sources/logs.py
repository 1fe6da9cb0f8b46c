"""Compiler, linter, test and mutation logs as findings and failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lines import following, found, lines_of, running

SPAN = "struct<file_name:string,line_start:int,column_start:int,line_end:int,column_end:int,is_primary:boolean>"


def compiler_findings(lines: DataFrame) -> DataFrame:
    """`compile.error` rows of compiler JSON lines (repo, line): errors at their primary span, else their first."""
    m = lines.select("repo", F.from_json("line", f"struct<reason:string,message:struct<level:string,message:string,code:struct<code:string>,spans:array<{SPAN}>>>").alias("j")).where("j.reason = 'compiler-message' and j.message.level = 'error'")
    span = F.coalesce(F.get(F.filter("j.message.spans", lambda s: s["is_primary"]), F.lit(0)), F.get("j.message.spans", F.lit(0)))
    placed = m.select("repo", F.col("j.message.message").alias("message"), F.col("j.message.code.code").alias("code"), span.alias("s")).where("s is not null")
    return placed.select("repo", F.concat_ws(":", F.lit("compile"), "s.file_name", F.col("s.line_start").cast("string"), F.col("s.column_start").cast("string")).alias("id"), F.lit("compile.error").alias("rule"), F.lit("error").alias("severity"), F.col("s.file_name").alias("file"), F.col("s.line_start").alias("start_line"), "code", "message")


def lint_first_diagnostic(logs: DataFrame) -> DataFrame:
    """Of each linter log (repo, log, text) its first located error, else its first located warning."""
    head = r"^(error|warning)(?:\[[^\]]*\])?: (.*)$"
    at = r"^\s*--> (.+?):(\d+):(\d+)\s*$"
    l = running(lines_of(logs, keys=["repo", "log"]), ["repo", "log"], block=F.col("line").rlike(head)).where("block > 0")
    place = F.struct("part", "pos")
    b = l.groupBy("repo", "log", "block").agg(F.min_by("line", place).alias("head"), F.min_by(F.when(F.col("line").rlike(at), F.col("line")), F.when(F.col("line").rlike(at), place)).alias("loc")).where("loc is not null")
    d = b.select("repo", "log", "block", F.regexp_extract("head", head, 1).alias("severity"), F.regexp_extract("head", head, 2).alias("message"), F.regexp_extract("loc", at, 1).alias("file"), F.regexp_extract("loc", at, 2).cast("int").alias("start_line"))
    w = Window.partitionBy("repo", "log").orderBy(F.col("severity") != "error", "block")
    return d.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "block")


def test_failures(logs: DataFrame) -> DataFrame:
    """Failed tests of test logs (repo, log, text) with the place and text of their panic, if it was logged; logs
    that name no failed test give their panics."""
    keys = ["repo", "log"]
    l = following(lines_of(logs, keys=keys), keys, "detail")
    panic = r"^thread '([^']+)'.* panicked at (.+?):(\d+):(\d+):?\s*$"
    panics = l.where(F.col("line").rlike(panic)).select(*keys, "pos", F.regexp_extract("line", panic, 1).alias("name"), F.regexp_extract("line", panic, 2).alias("file"), F.regexp_extract("line", panic, 3).cast("int").alias("start_line"), "detail", "part")
    first = panics.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "name").orderBy("part", "pos"))).where("_n = 1").drop("_n", "part", "pos")
    names = l.select(*keys, found("line", r"^test (\S+) \.\.\. FAILED\s*$").alias("name")).where("name is not null").distinct()
    named = names.join(first, [*keys, "name"], "left")
    rest = first.join(names.select(*keys).distinct(), keys, "left_anti")
    return named.unionByName(rest.select(named.columns))


def attribute_panics(failures: DataFrame, test_functions: DataFrame) -> DataFrame:
    """Failures whose panic lies outside the project, moved to the test function of that name; `.` if there is none.

    test_functions: repo, file, symbol, start_line. The place of the panic stays in panic_at."""
    last = F.element_at(F.split("name", "::"), -1)
    own = test_functions.groupBy("repo", F.col("symbol").alias("_last")).agg(F.min(F.struct("file", "start_line")).alias("t"))
    outside = F.col("file").isNull() | F.col("file").startswith("/") | F.col("file").rlike("^.:")
    j = failures.withColumn("_last", last).join(own, ["repo", "_last"], "left")
    return j.select("repo", "name", "detail", F.when(~outside, F.col("file")).otherwise(F.coalesce("t.file", F.lit("."))).alias("at_file"), F.when(~outside, F.col("start_line")).otherwise(F.col("t.start_line")).alias("at_line"), F.concat_ws(":", "file", F.col("start_line").cast("string")).alias("panic_at"))


def mutants(reports: DataFrame) -> DataFrame:
    """Outcomes of mutation reports (repo, text): summary, file, line and name of each mutant."""
    schema = "struct<outcomes:array<struct<summary:string,scenario:struct<Mutant:struct<name:string,file:string,span:struct<start:struct<line:int>>>>>>>"
    return reports.select("repo", F.inline(F.from_json("text", schema)["outcomes"])).where("scenario.Mutant is not null").select("repo", "summary", F.col("scenario.Mutant.file").alias("file"), F.col("scenario.Mutant.span.start.line").alias("line"), F.col("scenario.Mutant.name").alias("name"))
