"""Coverage reports of several tools as rows of report, file, line and hits.

reports: repo, report (its own path or name), text; or, for formats of lines and XML, the frames of
lines.read_lines with a repo beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import xml_attr
from .lines import carry, found, has_lines, lines_of, sections, text_lines

KEYS = ["repo", "report"]


def cov_istanbul(reports: DataFrame) -> DataFrame:
    """Statement hits of Istanbul JSON, at the statement's first line."""
    span = "struct<start:struct<line:int>>"
    parsed = reports.select(*KEYS, F.explode(F.from_json("text", f"map<string,struct<path:string,statementMap:map<string,{span}>,s:map<string,bigint>>>")).alias("key", "v"))
    rows = parsed.select(*KEYS, F.coalesce("v.path", "key").alias("file"), F.explode("v.statementMap").alias("id", "span"), F.col("v.s").alias("s"))
    return rows.select(*KEYS, "file", F.col("span.start.line").alias("line"), F.coalesce(F.try_element_at("s", F.col("id")), F.lit(0)).alias("hits")).where("line is not null")


def _tags(reports: DataFrame) -> DataFrame:
    """One row per XML tag, in order; a tag's text starts behind its bracket."""
    return lines_of(reports, keys=KEYS, sep="<")


def _first() -> Column:
    return F.element_at("lines", 1)["line"]


def cov_jacoco(reports: DataFrame) -> DataFrame:
    """Covered and missed lines of each method of JaCoCo XML, without constructors and initializers."""
    is_ = lambda name, tag: tag.rlike(f"^{name}[\\s>/]")
    tag = F.col("line")
    named = lambda name, attr, tag: F.when(is_(name, tag), F.coalesce(xml_attr(tag, attr), F.lit("")))
    method = lambda tag: named("method", "name", tag).when(tag.startswith("/method"), F.lit(""))
    line_of = lambda tag: is_("counter", tag) & (xml_attr(tag, "type") == "LINE")
    if has_lines(reports):
        t = carry(_tags(reports), KEYS, package=F.when(is_("package", tag), xml_attr("line", "name")), source=named("class", "sourcefilename", tag), method=method(tag), start=F.when(is_("method", tag), xml_attr("line", "line")))
        t = t.where(line_of(tag))
    else:
        # a package's classes, a class's methods, a method's counters
        t = sections(text_lines(reports, KEYS, sep="<"), KEYS, lambda x: is_("package", x)).withColumn("package", F.when(is_("package", _first()), xml_attr(_first(), "name")))
        t = sections(t, [*KEYS, "package"], lambda x: is_("class", x)).withColumn("source", named("class", "sourcefilename", _first()))
        t = sections(t, [*KEYS, "package", "source"], lambda x: is_("method", x) | x.startswith("/method")).withColumn("method", method(_first())).withColumn("start", xml_attr(_first(), "line"))
        t = t.select(*KEYS, "package", "source", "method", "start", F.explode_outer(F.filter("lines", lambda x: line_of(x["line"]))["line"]).alias("line")).where("line is not null")
    counters = t.where((F.col("method") != "") & ~F.col("method").isin("<init>", "<clinit>"))
    file = F.when(F.col("package") != "", F.concat_ws("/", "package", "source")).otherwise(F.col("source"))
    return counters.select(*KEYS, file.alias("file"), F.col("method").alias("symbol"), F.col("start").cast("int").alias("start_line"), xml_attr("line", "covered").cast("bigint").alias("covered"), xml_attr("line", "missed").cast("bigint").alias("missed"))


#: Holder element and its name, and attributes of a line's number and count.
COBERTURA, CLOVER = ("class", "filename", "number", "hits"), ("file", "name", "num", "count")


def _holder(tag: Column, form: tuple[str, ...]) -> Column:
    return F.when(tag.rlike(f"^{form[0]}[\\s>]"), xml_attr(tag, form[1]))


def _numbers(tag: Column, form: tuple[str, ...]) -> Column:
    """line and hits of a line element, null for other tags and for what is no line."""
    n, hits = xml_attr(tag, form[2]).cast("int"), xml_attr(tag, form[3]).cast("bigint")
    return F.when(tag.rlike("^line[\\s>/]") & (n > 0) & hits.isNotNull(), F.struct(n.alias("line"), hits.alias("hits")))


def _xml_lines(reports: DataFrame, form: tuple[str, ...]) -> DataFrame:
    if has_lines(reports):
        t = carry(_tags(reports), KEYS, file=_holder(F.col("line"), form))
        return t.where(F.col("file").isNotNull()).select(*KEYS, "file", _numbers(F.col("line"), form).alias("n")).where("n is not null").select(*KEYS, "file", "n.line", "n.hits")
    return _held(text_lines(reports, KEYS, sep="<"), form)


def _held(tags: DataFrame, form: tuple[str, ...]) -> DataFrame:
    held = sections(tags, KEYS, lambda x: _holder(x, form).isNotNull()).withColumn("file", _holder(_first(), form)).where("file is not null")
    return held.select(*KEYS, "file", F.inline_outer(F.filter(F.transform("lines", lambda x: _numbers(x["line"], form)), lambda n: n.isNotNull()))).where("line is not null")


def cov_cobertura(reports: DataFrame) -> DataFrame:
    """Lines of Cobertura XML's classes, by their file names; line 0 is no line."""
    return _xml_lines(reports, COBERTURA)


def cov_clover(reports: DataFrame) -> DataFrame:
    """Clover XML: reports that have Cobertura's shape as such, the others by file and line elements."""
    if has_lines(reports):
        first = cov_cobertura(reports)
        rest = reports.join(first.select(*KEYS).distinct(), KEYS, "left_anti")
        return first.unionByName(_xml_lines(rest, CLOVER))
    # a text shows its shape itself: a line of Cobertura's behind a class that names a file
    tags = text_lines(reports, KEYS, sep="<").withColumn("_class", F.get(F.filter("lines", lambda x: _holder(x["line"], COBERTURA).isNotNull()), F.lit(0))["pos"])
    shaped = F.coalesce(F.col("_class").isNotNull() & F.exists("lines", lambda x: (x["pos"] > F.col("_class")) & _numbers(x["line"], COBERTURA).isNotNull()), F.lit(False))
    form = lambda f, x: F.when(F.col("shaped"), f(x, COBERTURA)).otherwise(f(x, CLOVER))
    t = tags.select(*KEYS, "lines", shaped.alias("shaped"))
    held = sections(t, [*KEYS, "shaped"], lambda x: form(_holder, x).isNotNull()).withColumn("file", form(_holder, _first())).where("file is not null")
    return held.select(*KEYS, "file", F.inline_outer(F.filter(F.transform("lines", lambda x: form(_numbers, x["line"])), lambda n: n.isNotNull()))).where("line is not null")


def cov_lcov(reports: DataFrame) -> DataFrame:
    lines = carry(lines_of(reports, keys=KEYS), KEYS, file=found("line", "^SF:(.*?)\\s*$"))
    da = lines.where(F.col("line").rlike(r"^DA:\d+,\d+"))
    return da.select(*KEYS, "file", F.regexp_extract("line", r"^DA:(\d+),", 1).cast("int").alias("line"), F.regexp_extract("line", r"^DA:\d+,(\d+)", 1).cast("bigint").alias("hits"))


def cov_go(reports: DataFrame) -> DataFrame:
    """Blocks of Go cover profiles: file, start and end line, statements and count."""
    p = r"^(.+):(\d+)\.\d+,(\d+)\.\d+ (\d+) (\d+)\s*$"
    rows = lines_of(reports, keys=KEYS).where(F.col("line").rlike(p) & ~F.col("line").startswith("mode:"))
    g = lambda i: F.regexp_extract("line", p, i)
    return rows.select(*KEYS, g(1).alias("file"), g(2).cast("int").alias("start_line"), g(3).cast("int").alias("end_line"), g(4).cast("bigint").alias("statements"), g(5).cast("bigint").alias("hits"))


def go_line_rate(blocks: DataFrame) -> DataFrame:
    """Covered statements of all statements per repo; a block that stands in several profiles counts once."""
    once = blocks.groupBy("repo", "file", "start_line", "end_line").agg(F.max("statements").alias("s"), F.max("hits").alias("h"))
    return once.groupBy("repo").agg(F.try_divide(F.sum(F.when(F.col("h") > 0, F.col("s")).otherwise(0)), F.sum("s")).alias("line_rate"))


def cov_llvm(reports: DataFrame) -> DataFrame:
    """Functions of llvm-cov JSON: the covered fraction of the lines of their code regions, by the largest count of
    each line; functions without such regions are covered if they ran."""
    schema = "struct<data:array<struct<functions:array<struct<name:string,count:bigint,filenames:array<string>,regions:array<array<bigint>>>>>>>"
    # outer, as Spark would else parse the text again to filter empty arrays
    f = reports.select(*KEYS, F.explode_outer(F.from_json("text", schema)["data"]).alias("d")).select(*KEYS, F.posexplode_outer("d.functions").alias("_n", "_f")).where("_n is not null").select(*KEYS, "_f.*")
    f = f.select(*KEYS, F.get("filenames", F.lit(0)).alias("file"), "name", "count", F.filter("regions", lambda r: F.coalesce(F.get(r, F.lit(7)), F.lit(0)) == 0).alias("regions"))
    # a region is one span of lines, whatever its length; lines are counted from the spans of a function's records
    spans = F.transform(F.filter("regions", lambda r: F.get(r, F.lit(0)).isNotNull() & F.get(r, F.lit(4)).isNotNull()), lambda r: F.struct(r[0].alias("low"), F.greatest(r[0], F.get(r, F.lit(2))).alias("high"), (r[4] > 0).alias("hit")))
    g = f.groupBy(*KEYS, "file", "name").agg(F.array_sort(F.flatten(F.collect_list(F.coalesce(spans, F.array().cast("array<struct<low:bigint,high:bigint,hit:boolean>>"))))).alias("spans"), F.max("count").alias("count"))
    n = g.select(*KEYS, "file", "name", "count", _covered_lines(F.col("spans")).alias("lines"), _covered_lines(F.filter("spans", lambda x: x["hit"])).alias("hit"))
    return n.select(*KEYS, "file", "name", F.when(F.col("lines") > 0, F.col("hit") / F.col("lines")).otherwise((F.col("count") > 0).cast("double")).alias("coverage"))


def _covered_lines(spans: Column) -> Column:
    """How many lines sorted spans (low, high) hold, each once: a fold that keeps the furthest end so far."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-(1 << 62)).cast("bigint").alias("end"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("bigint"), x["high"] - F.greatest(x["low"] - 1, s["end"]))).alias("n"), F.greatest(s["end"], x["high"]).alias("end"))
    return F.aggregate(spans, start, step, lambda s: s["n"])


def cov_pytest(reports: DataFrame) -> DataFrame:
    """Executed and missing lines of pytest-cov JSON; a line that is both was executed."""
    schema = "struct<files:map<string,struct<executed_lines:array<int>,missing_lines:array<int>>>>"
    f = reports.select(*KEYS, F.explode_outer(F.from_json("text", schema)["files"]).alias("file", "v")).where("file is not null")
    # records of a file meet as arrays, so a file is one row until its lines are known
    both = lambda c: F.flatten(F.collect_list(F.coalesce(F.col("v")[c], F.array().cast("array<int>"))))
    g = f.groupBy(*KEYS, "file").agg(F.array_distinct(both("executed_lines")).alias("hit"), both("missing_lines").alias("not"))
    rows = lambda lines, n: F.transform(lines, lambda x: F.struct(x.alias("line"), F.lit(n).cast("bigint").alias("hits")))
    return g.select(*KEYS, "file", F.inline(F.concat(rows(F.col("hit"), 1), rows(F.array_except("not", "hit"), 0))))


def pytest_line_rate(reports: DataFrame) -> DataFrame:
    return reports.select(*KEYS, (F.get_json_object("text", "$.totals.percent_covered").cast("double") / 100).alias("line_rate"))
