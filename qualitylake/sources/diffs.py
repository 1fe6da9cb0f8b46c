"""Unified diffs as rows, and test-weakening findings over them.

patches: repo, patch (its number or name), text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lines import carry, found, has_lines, lines_of, running, sections, text_lines

KEYS = ["repo", "patch"]
HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
OLD, NEW = r"^--- a/(.*?)\t?$", r"^\+\+\+ (?:b/)?(.*?)\t?$"


def parse_diffs(patches: DataFrame) -> DataFrame:
    """repo, patch, path, deleted, hunk, hunk_start, pos, kind (context, added, removed), text and new_line of all hunk lines.

    The path is the new one, or the old one of a deleted file; hunk tells the hunks of a patch apart, hunk_start is the
    new line that its header names."""
    if not has_lines(patches):
        return _parse_texts(patches)
    line = F.col("line")
    l = running(lines_of(patches, keys=KEYS), KEYS, hunk=line.rlike(HUNK), file=line.startswith("diff --git ") | (line.startswith("--- ") & ~line.startswith("--- a/ ")))
    l = carry(l, [*KEYS, "file"], old=found("line", OLD), new=found("line", NEW), at=found("line", HUNK).cast("int"), of_file=F.when(line.rlike(HUNK), F.col("hunk")))
    body = l.where(F.col("of_file").isNotNull() & ~line.rlike(HUNK) & line.rlike(r"^[ +\-]"))
    kind = F.when(line.startswith("+"), "added").when(line.startswith("-"), "removed").otherwise("context")
    body = running(body, [*KEYS, "file", "hunk"], kept=kind != "removed")
    deleted = F.col("new") == "/dev/null"
    return body.select(*KEYS, F.when(deleted, F.col("old")).otherwise(F.col("new")).alias("path"), deleted.alias("deleted"), "hunk", F.col("at").alias("hunk_start"), "pos", kind.alias("kind"), F.substring(line, 2, 1 << 30).alias("text"), F.when(kind != "removed", F.col("at") + F.col("kept").cast("int") - 1).alias("new_line"))


def _parse_texts(patches: DataFrame) -> DataFrame:
    """parse_diffs of texts, cut at files, then at hunks: the place of a line among a hunk's kept ones numbers it."""
    files = sections(text_lines(patches, KEYS), KEYS, lambda x: x.startswith("diff --git ") | (x.startswith("--- ") & ~x.startswith("--- a/ ")))
    files = files.withColumn("_at", F.get(F.filter("lines", lambda x: x["line"].rlike(HUNK)), F.lit(0))["pos"])
    named = lambda p: found(F.try_element_at(F.filter("lines", lambda x: (x["pos"] < F.col("_at")) & x["line"].rlike(p)), F.lit(-1))["line"], p)
    hunks = sections(files.select(*KEYS, "lines", named(OLD).alias("old"), named(NEW).alias("new")), [*KEYS, "old", "new"], lambda x: x.rlike(HUNK))
    head = F.element_at("lines", 1)
    hunks = hunks.where(head["line"].rlike(HUNK)).select(*KEYS, "old", "new", head["pos"].alias("hunk"), F.regexp_extract(head["line"], HUNK, 1).cast("int").alias("at"), F.slice("lines", 2, F.size("lines")).alias("lines"))
    row = lambda x, kind, n: F.struct(x["pos"].alias("pos"), kind.alias("kind"), F.substring(x["line"], 2, 1 << 30).alias("text"), n.cast("int").alias("new_line"))
    kept = F.transform(F.filter("lines", lambda x: x["line"].rlike(r"^[ +]")), lambda x, i: row(x, F.when(x["line"].startswith("+"), "added").otherwise("context"), F.col("at") + i))
    removed = F.transform(F.filter("lines", lambda x: x["line"].startswith("-")), lambda x: row(x, F.lit("removed"), F.lit(None)))
    deleted = F.col("new") == "/dev/null"
    return hunks.select(*KEYS, F.when(deleted, F.col("old")).otherwise(F.col("new")).alias("path"), deleted.alias("deleted"), "hunk", F.col("at").alias("hunk_start"), F.inline_outer(F.concat(kept, removed))).where("kind is not null")


def _hunks(patches: DataFrame) -> DataFrame:
    """repo, path, first and last new line of each hunk of a file that stays; last is before first where none is left."""
    if has_lines(patches):
        l = running(lines_of(patches, keys=KEYS), KEYS, file=F.col("line").startswith("+++ "))
        l = carry(l, [*KEYS, "file"], path=found("line", NEW)).where(F.col("line").rlike(HUNK))
    else:
        l = sections(text_lines(patches, KEYS), KEYS, lambda x: x.startswith("+++ "))
        l = l.select("repo", found(F.element_at("lines", 1)["line"], NEW).alias("path"), F.explode_outer(F.filter("lines", lambda x: x["line"].rlike(HUNK))["line"]).alias("line")).where("line is not null")
    l = l.where("path <> '/dev/null'")
    n = F.regexp_extract("line", HUNK, 2)
    first = F.regexp_extract("line", HUNK, 1).cast("int")
    return l.select("repo", "path", first.alias("first"), (first + F.when(n == "", F.lit(1)).otherwise(n.cast("int")) - 1).alias("last"))


def _runs(patches: DataFrame) -> DataFrame:
    """repo, path, empty, first and last of the runs of new lines that hunk headers name; empty hunks stand behind."""
    h = _hunks(patches).withColumn("empty", ~F.coalesce(F.col("last") >= F.col("first"), F.lit(False)))
    w = Window.partitionBy("repo", "path").orderBy("empty", "first", "last")
    apart = F.coalesce(F.col("first") > F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    marked = h.withColumn("apart", apart.cast("int")).withColumn("n", F.sum("apart").over(w))
    return marked.groupBy("repo", "path", "empty", "n").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("n")


def changed_ranges(patches: DataFrame) -> DataFrame:
    """repo, path, first and last of the runs of new lines that hunk headers name: hunks that meet or touch are one."""
    return _runs(patches).where("not empty").drop("empty")


def changed_lines(patches: DataFrame) -> DataFrame:
    """path and the sorted distinct new line numbers that hunk headers name, per file; none for a file that only loses
    lines. For joins take `changed_ranges`, which has a row a run whatever its length."""
    runs = _runs(patches).groupBy("repo", "path").agg(F.array_sort(F.collect_list(F.when(~F.col("empty"), F.struct("first", "last")))).alias("runs"))
    return runs.select("repo", "path", F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"]))).alias("changed_lines"))


# What marks test code, removed and added tests, and assertions in lines of a diff
TEST_MARKS = ["#[test]", "#[tokio::test]", "mod tests", "fn test_"]
REMOVED_TESTS = ["#[test]", "fn test_"]
ASSERTIONS = ["assert_eq!", "assert_ne!", "assert_matches!", "assert!(", "debug_assert_eq!", "debug_assert_ne!", "debug_assert!("]
#: What each kind of weakening says.
WEAKENED = {
    "test_file_deleted": "a test file went in a change of product code",
    "test_removed": "a test went in a change of product code",
    "ignore_added": "a test is ignored since a change of product code",
    "should_panic_added": "a test may panic since a change of product code",
    "assert_loosened": "an exact assertion gave way to a looser one in a change of product code",
    "assertion_removed": "an assertion went in a change of product code",
}


def _any_of(text: Column, parts: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(p)) for p in parts])


def is_test_rust(path: str | Column) -> Column:
    """Whether a path is one of tests or benchmarks to the rules of weakening."""
    p = F.col(path) if isinstance(path, str) else path
    return p.startswith("tests/") | p.contains("/tests/") | p.endswith("_test.rs") | p.contains("/benches/")


def weakening(diff_lines: DataFrame) -> DataFrame:
    """Findings where a change to tests makes them weaker, of patches that change product Rust, too.

    Files count that are tests by their path, or of which a hunk shows test code. A deleted one is one finding. Else
    each hunk is read by itself: every removed line that opens a test, every added one that ignores a test or lets
    it panic; an exact assertion that goes while a loose one, or one on contents, comes (both may be reported);
    assertions that go without one in return. Findings stand at the line where the hunk starts."""
    own = [*KEYS, "path"]
    text, add, rem = F.col("text"), F.col("kind") == "added", F.col("kind") == "removed"
    n = lambda *when: F.count_if(reduce(Column.__and__, when))
    has = lambda *parts: _any_of(text, list(parts))
    hunks = diff_lines.groupBy(*own, "deleted", "hunk", "hunk_start").agg(
        n(_any_of(text, TEST_MARKS)).alias("marks"), n(rem, _any_of(text, REMOVED_TESTS)).alias("test_removed"), n(add, has("#[ignore]")).alias("ignore_added"), n(add, has("#[should_panic")).alias("should_panic_added"),
        n(rem, has("assert_eq!")).alias("exact"), n(add, has("assert!("), ~has("assert_eq!")).alias("loose"), n(add, has(".contains(", "contains(&")).alias("contents"),
        n(rem, _any_of(text, ASSERTIONS)).alias("gone"), n(add, _any_of(text, ASSERTIONS)).alias("new"),
    )
    product = F.max(F.col("path").endswith(".rs") & ~is_test_rust("path")).over(Window.partitionBy(*KEYS))
    file = Window.partitionBy(*own)
    first = F.min(F.when(F.col("deleted"), F.col("hunk"))).over(file) == F.col("hunk")
    touching = hunks.withColumn("product", product).where("product").withColumn("touches", F.max(is_test_rust("path") | (F.col("marks") > 0)).over(file)).withColumn("first", first).where("touches")
    loosened = F.when(F.col("exact") > 0, (F.col("loose") > 0).cast("int") + (F.col("contents") > 0).cast("int")).otherwise(0)
    lost = ((loosened == 0) & (F.col("gone") > 0) & (F.col("new") == 0)).cast("int")
    # one row a kind with how often it stands there; of a deleted file one in all
    each = [*((k, F.when(~F.col("deleted"), F.col(k))) for k in ("test_removed", "ignore_added", "should_panic_added")), ("assert_loosened", F.when(~F.col("deleted"), loosened)), ("assertion_removed", F.when(~F.col("deleted"), lost)), ("test_file_deleted", (F.col("deleted") & F.col("first")).cast("int"))]
    times = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("int").alias("n")) for k, v in each])
    line = F.when(F.col("deleted"), F.lit(1)).otherwise(F.col("hunk_start"))
    found_ = touching.select("repo", "path", line.alias("line"), F.inline(times)).where("n > 0").select("repo", "path", "line", "kind", F.explode(F.array_repeat(F.lit(0), F.col("n")))).drop("col")
    says = F.create_map(*[F.lit(x) for kv in WEAKENED.items() for x in kv])
    return found_.select("repo", F.lit("test_value.weakening").alias("rule"), F.lit("test_value").alias("engine"), F.lit("warning").alias("severity"), F.col("path").alias("file"), "line", "kind", says[F.col("kind")].alias("message"))
