"""Which files, functions and findings are in scope, and incremental scans.

paths: repo, path. deltas: repo, path, is_new_file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths
from ..sources.lines import PART, highest

#: Leading bytes of object files: ELF, Mach-O (both orders, 32 and 64 bit, universal), PE, WebAssembly, archives.
OBJECT_MAGIC = ("7F454C46", "FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE", "0061736D", "213C6172")
PE_MAGIC = "4D5A"
LARGEST = 64 << 20


def exclude_paths(files: DataFrame, globs: list[str], anchored: bool = False, column: str = "path") -> DataFrame:
    return files.where(~paths.matches_any(column, globs, anchored))


def skip_dirs(files: DataFrame, include: list[str] | None = None, hidden: bool = False, column: str = "path") -> DataFrame:
    return files.where(~paths.in_skipped_dir(column, include, hidden))


def with_generated(files: DataFrame, header: int = 16 << 10) -> DataFrame:
    """Add `generated`: a marker line stands in the leading comments of the first bytes of `content` (text).

    Lines are read as a fold over their array that stops at the first line of code."""
    text = F.lower(F.left("content", F.lit(header)))
    text = F.when((F.length("content") >= header) & ~text.endswith("\n"), F.regexp_replace(text, "[^\n]*$", "")).otherwise(text)
    lines = F.transform(F.split(F.regexp_replace(text, "^﻿", ""), "\r?\n"), lambda x: F.trim(x))
    hash_comments = F.coalesce(F.lower(paths.extension("path")).isin("py", "pyi", "sh", "bash", "zsh", "fish", "rb", "r", "pl", "pm", "ps1", "php", "yaml", "yml", "toml"), F.lit(False))

    def body(line, pattern: str):
        return F.trim(F.regexp_replace(F.regexp_replace(line, pattern, ""), r"(\*/|-->)+$", ""))

    def marked(comment):
        return comment.rlike(r"^@generated(\s|$)") | (comment.startswith("code generated ") & comment.endswith("do not edit."))

    def step(state, line):
        starts = line.startswith("//") | (line.startswith("#") & hash_comments) | line.startswith("/*") | line.startswith("<!--")
        comment = F.when(state["block"], body(line, r"^\**\s*")).otherwise(body(line, r"^(//|#|/\*|<!--)\s*"))
        live = ~state["done"] & (line != "")
        is_comment = state["block"] | starts
        block = F.when(live, F.when(state["block"] | line.startswith("/*"), ~line.contains("*/")).otherwise(F.lit(False))).otherwise(state["block"])
        closed_early = (state["block"] | line.startswith("/*")) & line.contains("*/") & ~line.endswith("*/")
        return F.struct(
            (state["hit"] | (live & is_comment & marked(comment))).alias("hit"),
            block.alias("block"),
            (state["done"] | (live & (~is_comment | closed_early))).alias("done"),
        )

    start = F.struct(F.lit(False).alias("hit"), F.lit(False).alias("block"), F.lit(False).alias("done"))
    return files.withColumn("generated", F.aggregate(lines, start, step, lambda s: s["hit"]))


def generated_warning(files: DataFrame, show: int = 5) -> DataFrame:
    """One warning per repo that has generated files: how many are skipped, with the first paths."""
    g = with_generated(files).where("generated").groupBy("repo").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("path")).alias("p"))
    return g.select("repo", F.lit("scope.generated").alias("rule"), F.lit("warning").alias("severity"), "n", F.array_join(F.slice("p", 1, show), ", ").alias("first"))


def route_files(files: DataFrame) -> DataFrame:
    """Add `route` to files with content (binary) and size: object, partial (too large) or scan."""
    head = F.hex(F.substring("content", 1, 4))
    is_object = head.isin(*OBJECT_MAGIC) | head.startswith(PE_MAGIC)
    return files.withColumn("route", F.when(F.coalesce(is_object, F.lit(False)), "object").when(F.col("size") > LARGEST, "partial").otherwise("scan"))


def partial_scan(routed: DataFrame) -> DataFrame:
    """One `secrets.partial` error per repo with files that were too large to scan, naming all of them."""
    g = routed.where(F.col("route") == "partial").groupBy("repo").agg(F.array_sort(F.collect_set("path")).alias("p"))
    return g.select("repo", F.lit("secrets.partial").alias("rule"), F.lit("error").alias("severity"), F.array_join("p", ", ").alias("paths"))


def empty_scope(repos: DataFrame, files: DataFrame) -> DataFrame:
    """A warning for each repo without any file in scope."""
    return repos.select("repo").distinct().join(files, "repo", "left_anti").select("repo", F.lit("scope.empty").alias("rule"), F.lit("warning").alias("severity"))


def os_metadata_warning(files: DataFrame) -> DataFrame:
    return files.where(paths.is_os_metadata("path")).groupBy("repo").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


def changed_files(files: DataFrame, deltas: DataFrame) -> DataFrame:
    return files.join(deltas.select("repo", "path"), ["repo", "path"], "left_semi")


def changed_functions(functions: DataFrame, ranges: DataFrame, new_files: DataFrame | None = None) -> DataFrame:
    """Functions that overlap a range of changed lines (repo, path, first, last); in new files (repo, path) all of them.

    Ranges and functions of a file stand in one order of lines: a function is touched where a range that starts by
    its end reaches its start. The furthest end of the ranges so far is handed on from part to part of the file, so
    neither long ranges nor large files make groups of pairs."""
    own = F.struct(*functions.columns)
    at = lambda pos: [F.floor(pos / (2 * PART)).alias("part"), F.lit(True).alias("split"), pos.alias("pos")]
    starts = ranges.select("repo", F.col("path").alias("file"), *at(2 * F.col("first")), F.col("last").cast("long").alias("to"), F.lit(None).cast(functions.select(own.alias("f")).schema["f"].dataType).alias("f"))
    ends = functions.select("repo", "file", *at(2 * F.col("end_line") + 1), F.lit(None).cast("long").alias("to"), own.alias("f"))
    met = highest(starts.unionByName(ends), ["repo", "file"], reached=F.col("to")).where("f is not null and reached >= f.start_line").select("f.*")
    if new_files is not None:
        met = met.unionByName(functions.join(new_files.select("repo", F.col("path").alias("file")).distinct(), ["repo", "file"], "left_semi").select(functions.columns))
    return met.distinct()


def new_symbols(head: DataFrame, base: DataFrame) -> DataFrame:
    return head.join(base.select("repo", "file", "symbol"), ["repo", "file", "symbol"], "left_anti")


def other_paths(tree: DataFrame, diff: DataFrame) -> DataFrame:
    """How many paths of each repo's tree a diff leaves alone."""
    return tree.join(diff.select("repo", "path"), ["repo", "path"], "left_anti").groupBy("repo").agg(F.count("*").alias("others"))


def independent_roots(roots: DataFrame) -> DataFrame:
    """Roots (repo, root, pack) below no other root of the same pack."""
    above = roots.select("repo", "pack", "root", F.explode(F.filter(paths.ancestors("root"), lambda a: a != F.col("root"))).alias("up"))
    nested = above.join(roots.select("repo", "pack", F.col("root").alias("up")), ["repo", "pack", "up"], "left_semi").select("repo", "pack", "root").distinct()
    return roots.join(nested, ["repo", "pack", "root"], "left_anti")


def scope_secrets(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings on changed paths, and those of the whole repository (`.`)."""
    kept = findings.where("file <> '.'").join(changed.select("repo", F.col("path").alias("file")), ["repo", "file"], "left_semi")
    return kept.unionByName(findings.where("file = '.'").select(kept.columns))


def known_paths(scored: DataFrame, tree: DataFrame) -> DataFrame:
    """Paths of both, once, with `scored` marking those of scored files."""
    both = scored.select("repo", "path", F.lit(True).alias("scored")).unionByName(tree.select("repo", "path", F.lit(False).alias("scored")))
    return both.groupBy("repo", "path").agg(F.bool_or("scored").alias("scored"))


def scope_paths(paths_: DataFrame) -> DataFrame:
    return paths_.select("repo", "path").distinct().orderBy("repo", "path")


def changed_paths(diff: DataFrame, untracked: DataFrame) -> DataFrame:
    """Names of a diff and untracked ones, without blanks, once."""
    return diff.select("repo", "path").union(untracked.select("repo", "path")).where(F.trim("path") != "").distinct()


def changed_paths_label(changed: DataFrame, show: int = 3) -> DataFrame:
    """The first paths of each repo joined, with `+n more`."""
    w = Window.partitionBy("repo").orderBy("path")
    g = changed.select("repo", "path").distinct().withColumn("_n", F.row_number().over(w)).groupBy("repo").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_n") <= show, F.col("path")))).alias("p"))
    return g.select("repo", F.concat(F.array_join("p", ", "), F.when(F.col("n") > show, F.concat(F.lit(" +"), (F.col("n") - show).cast("string"), F.lit(" more"))).otherwise("")).alias("label"))


def added_lines(numstat: DataFrame, files: DataFrame, scope: DataFrame) -> DataFrame:
    """Added lines per repo: of a numstat (`-` of binaries is 0), and all lines of files in scope it does not list.

    numstat: repo, path, added STRING. files: repo, path, loc."""
    stat = numstat.join(scope.select("repo", "path"), ["repo", "path"], "left_semi").select("repo", F.coalesce(F.expr("try_cast(added as bigint)"), F.lit(0)).alias("n"))
    new = scope.select("repo", "path").distinct().join(numstat, ["repo", "path"], "left_anti").join(files, ["repo", "path"]).select("repo", F.col("loc").cast("long").alias("n"))
    return stat.unionByName(new).groupBy("repo").agg(F.sum("n").alias("added"))


# What names a pack
#: Files that make their folder a root of a pack.
PACK_MARKERS = {
    "Cargo.toml": "rust", "package.json": "node", "pyproject.toml": "python", "requirements.txt": "python", "setup.py": "python", "Pipfile": "python", "go.mod": "go",
    "pom.xml": "java", "build.gradle": "java", "build.gradle.kts": "java", "composer.json": "php", "CMakeLists.txt": "cpp",
}
#: Extensions that do so, in any letter case.
PACK_MARKER_EXTENSIONS = {"csproj": "csharp", "sln": "csharp"}
#: Build files that do so beside sources of C.
C_BUILD = ["Makefile", "makefile", "GNUmakefile", "configure", "configure.ac"]
PACK_SOURCES = {
    "rs": "rust", "js": "node", "jsx": "node", "mjs": "node", "cjs": "node", "ts": "node", "tsx": "node", "py": "python", "go": "go", "java": "java", "cs": "csharp", "php": "php",
    "c": "cpp", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "sh": "bash", "bash": "bash",
}


def pack_roots(files: DataFrame) -> DataFrame:
    """repo and root: each folder with a marker file or a C build file, and each repository's own root, `.`."""
    d = paths.dirname("path")
    marks = paths.basename("path").isin(*PACK_MARKERS, *C_BUILD) | F.lower(paths.extension("path")).isin(*PACK_MARKER_EXTENSIONS)
    return files.where(marks).select("repo", F.when(d == "", ".").otherwise(d).alias("root")).unionByName(files.select("repo", F.lit(".").alias("root"))).distinct()


def owned_files(files: DataFrame, roots: DataFrame) -> DataFrame:
    """repo, root and below (the path in it) of each file: its root is the nearest one at or above its folder."""
    up = files.select("repo", "path", F.explode(F.array_distinct(F.concat(F.array(F.lit(".")), paths.ancestors("path")))).alias("root"))
    near = up.join(roots.select("repo", "root"), ["repo", "root"]).groupBy("repo", "path").agg(F.max_by("root", F.when(F.col("root") == ".", 0).otherwise(F.length("root"))).alias("root"))
    return near.select("repo", "root", F.when(F.col("root") == ".", F.col("path")).otherwise(F.substr("path", F.length("root") + 2)).alias("below"))


def detect_packs(files: DataFrame) -> DataFrame:
    """repo, root, pack and markers (the packs that markers name) of each root, by the files whose nearest root it is.

    A package.json beside shell scripts only names no pack, a Makefile or configure script one where there are sources
    of C. One named pack decides. Of several, the only one with sources decides, else the pack is ambiguous. Without
    one: web with pages in the root, bash with scripts in it or in its scripts or bin folder, else unknown; nested
    roots that no marker names in the end give no row, and their files count for the root above."""
    base, d = paths.basename("below"), paths.dirname("below")
    ext = F.lower(paths.extension("below"))
    at_root = d == ""
    of = lambda table, key: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)

    def found(owned: DataFrame) -> DataFrame:
        shell = ext.isin("sh", "bash") & d.isin("", "scripts", "bin")
        g = owned.groupBy("repo", "root").agg(
            F.collect_set(F.when(at_root, of(PACK_MARKERS, base))).alias("named"),
            F.bool_or(ext.isin(*PACK_MARKER_EXTENSIONS)).alias("csharp"),
            F.bool_or(at_root & base.isin(*C_BUILD)).alias("build"),
            F.collect_set(of(PACK_SOURCES, paths.extension("below"))).alias("sources"),
            F.bool_or(ext.isin("js", "jsx", "mjs", "cjs", "ts", "tsx")).alias("scripted"), F.bool_or(ext.isin("c", "cc", "cpp", "cxx")).alias("compiled"),
            F.bool_or(shell).alias("shell"), F.bool_or(at_root & ext.isin("html", "htm")).alias("pages"),
        )
        named = F.filter("named", lambda p: (p != "node") | F.col("scripted") | ~F.col("shell"))
        more = F.filter(F.array(F.when(F.col("csharp"), F.lit("csharp")), F.when(F.col("build") & F.col("compiled"), F.lit("cpp"))), lambda p: p.isNotNull())
        return g.withColumn("marked", F.array_sort(F.array_distinct(F.concat(named, more))))

    roots = pack_roots(files)
    firm = found(owned_files(files, roots)).where("root = '.' or size(marked) > 0").select("repo", "root")
    g = found(owned_files(files, firm))
    owners = F.array_intersect("marked", "sources")
    pack = F.when(F.size("marked") == 1, F.try_element_at("marked", F.lit(1))).when((F.size("marked") > 1) & (F.size(owners) == 1), F.try_element_at(owners, F.lit(1))).when(F.size("marked") > 1, "ambiguous").when(F.col("pages"), "web").when(F.col("shell"), "bash").otherwise("unknown")
    return g.select("repo", "root", pack.alias("pack"), F.array_join("marked", ",").alias("markers"))


def missing_license_header(files: DataFrame, header: str, column: str = "content") -> DataFrame:
    """Files whose first line is not the header."""
    return files.where(F.coalesce(F.split(column, "\r?\n")[0], F.lit("")) != header)


def attribution_hits(messages: DataFrame, pattern: str, allowed: list[str] | None = None) -> DataFrame:
    """Lines of messages that match a pattern in any letter case, but for the lines allowed as they stand."""
    lines = messages.select("repo", "id", F.posexplode(F.split("message", "\r?\n")).alias("line", "text"))
    hit = F.col("text").rlike(f"(?i){pattern}")
    return lines.where(hit & ~F.trim("text").isin(*(allowed or [""]))).select("repo", "id", (F.col("line") + 1).alias("line"), "text")


def scan_incremental(files: DataFrame, clean: DataFrame, scan: Callable[[DataFrame], DataFrame], column: str = "content") -> tuple[DataFrame, DataFrame]:
    """Findings of the files not known as clean, and the next set of clean (hash, path) pairs.

    A file counts as clean by its content and path; files with findings are never added, so they are scanned
    again until they are clean."""
    hashed = files.withColumn("hash", F.sha2(F.col(column).cast("binary"), 256))
    todo = hashed.join(clean.select("hash", "path"), ["hash", "path"], "left_anti")
    found = scan(todo)
    next_clean = hashed.select("hash", "path").distinct().join(todo.join(found.select("repo", F.col("file").alias("path")).distinct(), ["repo", "path"], "left_semi").select("hash", "path"), ["hash", "path"], "left_anti")
    return found, next_clean
