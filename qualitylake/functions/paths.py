"""Path predicates and derivations as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory, file and extension names with a meaning.
GENERATED_DIRS = (
    "target", "dist", "build", "out", "cdk.out", "coverage", "generated", "vendor", ".yarn", ".cache",
    "node_modules", "__pycache__", ".next", ".nuxt", ".output", ".turbo", ".parcel-cache", ".pytest_cache",
    ".mypy_cache", ".ruff_cache", ".tox", ".venv", "venv", ".gradle", "bin", "obj", "Pods", "Carthage",
    "bower_components", "storybook-static",
)
ALWAYS_SKIPPED_DIRS = (".git", ".hg", ".svn", ".sc")
TEST_DIRS = ("test", "tests", "__tests__", "spec", "testdata")
TEST_STEM_ENDS = ("_test", "_tests", "_spec", "_unittest", "-test", "-spec", ".test", ".spec", "Test", "Tests")
LANGUAGES = {
    "rs": "rust",
    "js": "node", "jsx": "node", "mjs": "node", "cjs": "node", "ts": "node", "tsx": "node",
    "py": "python", "go": "go", "java": "java", "cs": "csharp", "php": "php",
    "c": "cpp", "cc": "cpp", "cpp": "cpp", "cxx": "cpp",
    "sh": "bash", "bash": "bash",
}
# End of fixed values.


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize(path: str | Column) -> Column:
    """Forward slashes only, without empty and `.` parts."""
    parts = F.split(F.replace(c(path), F.lit("\\"), F.lit("/")), "/")
    return F.array_join(F.filter(parts, lambda p: (p != "") & (p != ".")), "/")


def basename(path: str | Column) -> Column:
    return F.element_at(F.split(c(path), "/"), -1)


def dirname(path: str | Column) -> Column:
    """The directory part; empty for a bare name."""
    return F.regexp_replace(c(path), "/?[^/]*$", "")


def extension(path: str | Column) -> Column:
    """Text behind the last point of the file name, null without one; a leading point starts no extension."""
    found = F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)
    return F.when(found != "", found)


def stem(path: str | Column) -> Column:
    """The file name without its extension."""
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]*$", "$1")


def language_of(path: str | Column) -> Column:
    """The language that a file's extension stands for, or null."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    ext = extension(path)
    return F.when(ext.isNotNull(), F.try_element_at(table, ext))


def is_os_metadata(path: str | Column) -> Column:
    name = basename(path)
    return (name == ".DS_Store") | name.startswith("._")


def is_test_path(path: str | Column) -> Column:
    """Whether a path lies in a test directory or names a test file."""
    parts = F.split(c(path), "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    in_dir = F.exists(dirs, lambda p: p.isin(*TEST_DIRS) | p.endswith(".Tests") | p.endswith(".Test"))
    ends = "|".join(re.escape(e) for e in TEST_STEM_ENDS)
    return in_dir | (basename(path) == "conftest.py") | stem(path).rlike(f"^test_|({ends})$")


def glob_pattern(glob: str, anchored: bool = False) -> str | None:
    """A glob as a regular expression over relative paths, or None for a blank one.

    `dir/**` matches any run of path components (with `anchored`, a plain `dir/**` only from the root); other
    globs match the path itself or what lies below it."""
    glob = glob.strip()
    while glob.startswith("./"):
        glob = glob[2:]
    if not glob:
        return None
    if not glob.endswith("/**"):
        return f"^{re.escape(glob)}(/|$)"
    body = glob[:-3]
    rooted = anchored and not body.startswith("**/")
    while body.startswith("**/"):
        body = body[3:]
    parts = [re.escape(p) for p in body.strip("/").split("/") if p]
    if not parts:
        return ""
    return ("^" if rooted else "(^|/)") + "/+".join(parts) + "(/|$)"


def matches_any(path: str | Column, globs: list[str], anchored: bool = False) -> Column:
    patterns = [p for p in (glob_pattern(g, anchored) for g in globs) if p is not None]
    hit = F.lit(False)
    for p in patterns:
        hit = hit | (c(path).rlike(p) if p else F.lit(True))
    return hit


def in_skipped_dir(path: str | Column, include: list[str] | None = None, hidden: bool = False) -> Column:
    """Whether a directory above the file is generated, version control or hidden; `include` opens generated ones."""
    parts = F.split(c(path), "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    skipped = F.exists(dirs, lambda p: p.isin(*ALWAYS_SKIPPED_DIRS))
    if not hidden:
        skipped = skipped | F.exists(dirs, lambda p: p.startswith(".") & ~p.isin(*GENERATED_DIRS))
    generated = F.filter(F.transform(dirs, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: x["p"].isin(*GENERATED_DIRS) & ((x["p"] != "target") | (x["i"] == 0)))
    if include:
        any_generated = F.filter(F.transform(dirs, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: x["p"].isin(*GENERATED_DIRS))
        opened = F.exists(any_generated, lambda x: matches_any(F.array_join(F.slice(parts, 1, x["i"] + 1), "/"), include))
        return skipped | ((F.size(generated) > 0) & ~opened)
    return skipped | (F.size(generated) > 0)


def local_target(value: str | Column) -> Column:
    """The local part of a link, without query and fragment; null for anchors, hosts and other schemes."""
    v = F.trim(c(value))
    outside = (v == "") | v.startswith("#") | v.startswith("//") | F.lower(v).rlike("^(https?|mailto|tel|data|javascript|blob):")
    cut = F.regexp_replace(v, "[?#].*$", "")
    return F.when(~outside & (cut != ""), cut)


def resolve(page: str | Column, target: str | Column) -> Column:
    """A link target as a path below the site's root: `/x` from the root, else from the page's directory; `..`
    goes up, and what would leave the root stays there."""
    joined = F.when(c(target).startswith("/"), c(target)).otherwise(F.concat_ws("/", dirname(page), c(target)))
    parts = F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(up, "/")


def ancestors(path: str | Column) -> Column:
    """All directories above a path, nearest first, ending with `.`."""
    parts = F.split(c(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, F.size(parts) - n), "/"))
    return F.concat(F.filter(above, lambda p: p != ""), F.array(F.lit(".")))
