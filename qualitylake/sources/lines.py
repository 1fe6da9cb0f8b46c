"""Line formats as tables: lines with positions, and values handed on from the lines that set them.

Lines stand in parts: ordered ranges of one text, which any task may hold. A scan over the lines of a text has two
levels, so no task needs the whole of it: each part is scanned by itself and sums up what it hands on, the sums are
scanned in the order of the parts, and each part takes what the parts before it hand on. Texts that fit in one part
send no sums. `read_lines` reads files in parts as Spark splits them, however large they are.

Texts that stand in a row need no scan: `text_lines` and `sections` cut them where they stand, without a shuffle, and
what a section's lines share is read from its first line."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lines of a part.
PART = 1 << 16


def read_lines(spark: SparkSession, path: str, sep: str | None = None, name: str = "report") -> DataFrame:
    """The lines of the files at a path: the file's path as `name`, part, split, pos and line. Readers take such
    frames in place of texts; `sep` is "<" for those of XML. `pos` orders the lines of a part, and numbers none."""
    read = spark.read if sep is None else spark.read.option("lineSep", sep)
    return read.text(path).select(F.col("_metadata.file_path").alias(name), F.col("_metadata.file_block_start").alias("part"), F.lit(True).alias("split"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


def lines_of(df: DataFrame, text: str = "text", keys: list[str] | None = None, sep: str = "\r?\n") -> DataFrame:
    """keys, part, split (whether the text has several parts), pos and line of each text's lines, without their ends.
    A frame of `read_lines` is taken as it is."""
    if has_lines(df):
        return df.select(*(keys or []), "part", "split", "pos", "line")
    keys = keys or [c for c in df.columns if c != text]
    cut = df.select(*keys, F.split(F.coalesce(F.col(text), F.lit("")), sep).alias("_lines"))
    each = cut.select(*keys, (F.size("_lines") > PART).alias("split"), F.posexplode("_lines").alias("pos", "line"))
    return each.select(*keys, F.floor(F.col("pos") / PART).alias("part"), "split", "pos", "line")


def has_lines(df: DataFrame) -> bool:
    """Whether a frame is one of `read_lines`, not of texts."""
    return {"part", "split", "pos", "line"} <= set(df.columns)


def text_lines(df: DataFrame, keys: list[str], text: str = "text", sep: str = "\r?\n") -> DataFrame:
    """keys and `lines` (pos and line) of each text."""
    return df.select(*keys, F.transform(F.split(F.coalesce(F.col(text), F.lit("")), sep), lambda x, i: F.struct(i.alias("pos"), x.alias("line"))).alias("lines"))


def sections(df: DataFrame, keys: list[str], starts: Callable[[Column], Column]) -> DataFrame:
    """`lines` cut before each line that starts a section: a row each, and one of what stands before the first.

    There is always one, so `explode_outer` gives the same rows; for `explode` Spark would work out the array again, and
    all it is made of, to filter empty ones."""
    at = F.filter(F.transform("lines", lambda x, i: F.when((i == 0) | starts(x["line"]), i + 1)), lambda i: i.isNotNull())
    marked = df.select(*keys, "lines", at.alias("_at"))
    return marked.select(*keys, F.explode_outer(F.transform("_at", lambda s, i: F.slice("lines", s, F.coalesce(F.get("_at", i + 1), F.size("lines") + 1) - s))).alias("lines"))


def _handed(df: DataFrame, keys: list[str], last: dict[str, Column] | None = None, count: dict[str, Column] | None = None, most: dict[str, Column] | None = None) -> DataFrame:
    """Add, for each line, the last non-null value up to it, the count of lines that meet a condition, or the largest
    value, within `keys` and in the order of parts and of positions in them."""
    last, most, one = last or {}, most or {}, {n: F.coalesce(f, F.lit(False)).cast("int") for n, f in (count or {}).items()}
    names, parts = [*last, *one, *most], [*keys, "part"]
    here = Window.partitionBy(*parts).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.select("*", *[F.last(v, ignorenulls=True).over(here).alias(n) for n, v in last.items()], *[F.sum(v).over(here).alias(n) for n, v in one.items()], *[F.max(v).over(here).alias(n) for n, v in most.items()])
    sums = [F.max_by(v, F.when(v.isNotNull(), F.col("pos"))).alias(n) for n, v in last.items()] + [F.sum(v).alias(n) for n, v in one.items()] + [F.max(v).alias(n) for n, v in most.items()]
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    scan = {**{n: F.last(n, ignorenulls=True) for n in last}, **{n: F.sum(n) for n in one}, **{n: F.max(n) for n in most}}
    entries = df.where("split").groupBy(*parts).agg(*sums)
    entries = entries.select(*[F.col(k).alias(f"_of_{k}") for k in parts], *[scan[n].over(before).alias(f"_in_{n}") for n in names])
    entries = entries.where(reduce(Column.__or__, [F.col(f"_in_{n}").isNotNull() for n in names]))
    joined = local.join(entries, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in parts]), "left")
    merged = [F.coalesce(n, f"_in_{n}").alias(n) for n in last] + [(F.col(n) + F.coalesce(f"_in_{n}", F.lit(0))).alias(n) for n in one] + [F.greatest(n, f"_in_{n}").alias(n) for n in most]
    return joined.select(*df.columns, *merged)


def carry(df: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """Add columns that hold the last non-null value of an expression up to each line, within `keys`."""
    return _handed(df, keys, last=values)


def running(df: DataFrame, keys: list[str], **flags: Column) -> DataFrame:
    """Add running counts of lines that meet a condition, within `keys`."""
    return _handed(df, keys, count=flags)


def highest(df: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """Add columns that hold the largest value of an expression up to each line, within `keys`."""
    return _handed(df, keys, most=values)


def following(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add the next line of each line, within `keys`."""
    parts = [*keys, "part"]
    local = df.withColumn(name, F.lead("line").over(Window.partitionBy(*parts).orderBy("pos")))
    firsts = df.where("split").groupBy(*parts).agg(F.min_by("line", "pos").alias("_first"), F.max("pos").alias("_pos"))
    behind = firsts.select(*[F.col(k).alias(f"_of_{k}") for k in parts], "_pos", F.lead("_first").over(Window.partitionBy(*keys).orderBy("part")).alias("_next"))
    met = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in parts]) & (F.col("pos") == F.col("_pos"))
    return local.join(behind, met, "left").select(*df.columns, F.coalesce(name, "_next").alias(name))


def found(line: str | Column, pattern: str, group: int = 1) -> Column:
    """A regular expression's group, null without a match."""
    c = F.col(line) if isinstance(line, str) else line
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))
