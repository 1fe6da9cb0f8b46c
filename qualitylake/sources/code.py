"""Functions, imports, public items and dependency declarations of source files (repo, path, content)."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, scoring
from .lines import carry, found, lines_of, sections, text_lines

FUNCTION = "repo string, file string, symbol string, start_line int, end_line int, cc int"
DECISIONS = r"\b(?:if|for|while|case|catch|elif)\b|&&|\|\||(?<!\?)\?(?![?.:])"
_HEADERS = {
    "go": r"^\s*func\s+(?:\([^)]*\)\s*)?(\w+)\s*[(\[]",
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(\w+)",
    "php": r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(\w+)\s*\(",
    "node": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)\s*\(|^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>|^\s*(?:async\s+|static\s+|get\s+|set\s+)*(?!(?:if|for|while|switch|catch|return|function)\b)(\w+)\s*\([^)]*\)\s*\{",
}
_C_LIKE = r"^\s*(?!(?:if|for|while|switch|catch|return|else|do|new|throw)\b)(?:[\w:<>,\[\]*&~?]+\s+)+[*&]*(~?\w+(?:::~?\w+)*)\s*\([^;{}]*\)\s*(?:const\s*)?(?:throws\s+[\w.,\s]+)?\{?\s*$"


_BLOCK, _LINE, _DOUBLE = r"/\*.*?\*/", r"//[^\n]*", r'"(?:\\.|[^"\\])*"'
_QUOTED = r"'(?:\\.|[^'\\\n])*'"
#: What holds no code, by language, in the order in which a place is tried: comments, texts and characters.
_NO_CODE = {
    # a quote before a name without one behind is a lifetime and stays
    "rust": [_LINE, r"/\*", r'\b(?:br|cr|r)(#*)".*?"\1', _DOUBLE, r"'(?:\\(?:u\{[^}']*\}|x..|.)|[^\\'\n])'"],
    "go": [_LINE, _BLOCK, _DOUBLE, r"`[^`]*`", _QUOTED],
    "java": [_LINE, _BLOCK, r'""".*?"""', _DOUBLE, _QUOTED],
    "php": [_LINE, r"#(?!\[)[^\n]*", _BLOCK, r"<<<\s*([\"']?)(\w+)\1\n.*?\n\s*\2\b", _DOUBLE, r"'(?:\\.|[^'\\])*'"],
    "node": [_LINE, _BLOCK, _DOUBLE, _QUOTED, r"`(?:\\.|[^`\\])*`"],
}
#: C and its kin: a quote inside a number parts its digits.
_NO_CODE_C = [_LINE, _BLOCK, r'\bu?8?[LU]?R"([^()\s\\]*)\(.*?\)\1"', _DOUBLE, r"(?<![0-9a-fA-F])'(?:\\.|[^'\\\n])*'"]
_LEXERS = {k: re.compile("|".join(f"(?:{p})" for p in v), re.DOTALL) for k, v in {**{k: v for k, v in _NO_CODE.items() if k != "php"}, "": _NO_CODE_C}.items()}
# the groups of a heredoc stand in the whole pattern
_LEXERS["php"] = re.compile("|".join(_NO_CODE["php"]), re.DOTALL)


def _plain(code: str, language: str) -> str:
    """Comments, texts and characters blanked, line ends kept."""
    lexer, out, at = _LEXERS.get(language, _LEXERS[""]), [], 0
    while m := lexer.search(code, at):
        end = m.end()
        if m[0] == "/*":
            # comments of Rust may hold others; one that stays open runs to the end
            depth = 0
            for x in re.compile(r"/\*|\*/").finditer(code, m.start()):
                depth += 1 if x[0] == "/*" else -1
                if not depth:
                    end = x.end()
                    break
            else:
                end = len(code)
        out += [code[at : m.start()], re.sub(r"[^\n]", " ", code[m.start() : end])]
        at = end
    return "".join([*out, code[at:]])


def brace_functions(code: str, language: str) -> list[tuple[str, int, int, int]]:
    """(symbol, first line, last line, complexity) of functions with a body in braces."""
    lines = _plain(code, language).split("\n")
    header = re.compile(_HEADERS.get(language, _C_LIKE))
    out, open_at, depth = [], [], 0
    for n, line in enumerate(lines, 1):
        m = header.match(line)
        waiting = (next(g for g in m.groups() if g), n) if m else None
        if waiting:
            open_at.append([waiting[0], n, None])
        for ch in line:
            if ch == "{":
                depth += 1
                if open_at and open_at[-1][2] is None:
                    open_at[-1][2] = depth
            elif ch == "}":
                if open_at and open_at[-1][2] == depth:
                    name, start, _ = open_at.pop()
                    body = "\n".join(lines[start - 1 : n])
                    out.append((name, start, n, 1 + len(re.findall(DECISIONS, body))))
                depth = max(0, depth - 1)
            elif ch == ";" and open_at and open_at[-1][2] is None:
                open_at.pop()
    return sorted(out, key=lambda f: f[1])


def python_functions(code: str) -> list[tuple[str, int, int, int]]:
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return []
    out: list[tuple[str, int, int, int]] = []

    def decisions(node: ast.AST) -> int:
        n = 0
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                continue
            n += isinstance(x, ast.If | ast.For | ast.AsyncFor | ast.While | ast.ExceptHandler | ast.IfExp | ast.comprehension | ast.match_case)
            n += len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0
            n += decisions(x)
        return n

    def walk(node: ast.AST, prefix: str) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
                out.append((prefix + x.name, x.lineno, x.end_lineno or x.lineno, 1 + decisions(x)))
                walk(x, prefix + x.name + ".")
            elif isinstance(x, ast.ClassDef):
                walk(x, prefix + x.name + ".")
            else:
                walk(x, prefix)

    walk(tree, "")
    return out


_known_functions = lru_cache(maxsize=4096)(python_functions)


def _python_functions(code: str) -> list[tuple[str, int, int, int]]:
    """python_functions; a worker parses equal short files (copies, empty packages) once, 4,096 different ones at most."""
    return _known_functions(code) if len(code) <= 8192 else python_functions(code)


def python_imports(code: str) -> list[tuple[str, int]]:
    """(top module, line) of absolute imports outside try blocks that catch ImportError."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        hits = [(n, re.match(r"\s*(?:import\s+(\w+)|from\s+(\w+)[\w.]*\s+import\b)", line)) for n, line in enumerate(code.split("\n"), 1)]
        return [(m[1] or m[2], n) for n, m in hits if m and (m[1] or m[2]) != "__future__"]
    out: list[tuple[str, int]] = []

    def guards(handler: ast.ExceptHandler) -> bool:
        names = [handler.type] if not isinstance(handler.type, ast.Tuple) else handler.type.elts
        return any(isinstance(x, ast.Name) and x.id in ("ImportError", "ModuleNotFoundError") for x in names)

    def walk(node: ast.AST) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.Try) and any(guards(h) for h in x.handlers):
                for y in [*x.orelse, *x.finalbody]:
                    walk(y)
            elif isinstance(x, ast.Import):
                out.extend((a.name.split(".")[0], x.lineno) for a in x.names)
            elif isinstance(x, ast.ImportFrom) and not x.level and x.module != "__future__":
                out.append((x.module.split(".")[0], x.lineno))
            else:
                walk(x)

    walk(tree)
    return out


def functions(files: DataFrame) -> DataFrame:
    """Functions of all files in a language with braces and of Python; shell files by windows alone."""
    known = files.withColumn("lang", paths.language_of("path")).where("lang is not null and content is not null")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for repo, file, lang, code in zip(b.repo, b.path, b.lang, b.content):
                for f in _python_functions(code) if lang == "python" else brace_functions(code, lang):
                    rows.append((repo, file, *f))
            yield pd.DataFrame(rows, columns=["repo", "file", "symbol", "start_line", "end_line", "cc"])

    code = known.where("lang <> 'bash'").select("repo", "path", "lang", "content").mapInPandas(read, FUNCTION)
    return code.unionByName(shell_functions(known.where("lang = 'bash'")))


def shell_functions(files: DataFrame) -> DataFrame:
    """Shell functions: a body runs to the next header, so each is a section; decisions are counted per line and summed."""
    keys = ["repo", "file"]
    header = r"^\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\s*\)\s*\{?|^\s*function\s+([A-Za-z_][\w-]*)"
    is_header = lambda x: x.rlike(header)
    l = text_lines(files.select("repo", F.col("path").alias("file"), "content"), keys, "content")
    l = l.select(*keys, F.transform("lines", lambda x: F.struct(x["pos"].alias("pos"), F.regexp_replace(x["line"], r"(^|\s)#.*$", "").alias("line"))).alias("lines"))
    f = sections(l, keys, is_header).withColumn("first", F.element_at("lines", 1)).where(is_header(F.col("first.line")))
    name = F.concat(F.regexp_extract("first.line", header, 1), F.regexp_extract("first.line", header, 2))
    last = F.element_at(F.filter("lines", lambda x: F.trim(x["line"]) != ""), -1)["pos"]
    hits = F.aggregate("lines", F.lit(1), lambda n, x: n + F.regexp_count(x["line"], F.lit(r"\b(if|elif|for|while|until)\b|&&|\|\||;;")))
    return f.select(*keys, name.alias("symbol"), (F.col("first.pos") + 1).alias("start_line"), (last + 1).alias("end_line"), hits.alias("cc"))


def test_functions(files: DataFrame) -> DataFrame:
    """repo, file, symbol and start_line of the test functions of Rust files (repo, path, content): the `fn` in the four
    lines behind a test attribute, with nothing but blank lines, attributes and comments before it."""
    rust = files.where(F.col("path").endswith(".rs") & F.contains("content", F.lit("#[test"))).select("repo", F.col("path").alias("file"), F.transform(F.split("content", "\r?\n"), lambda x: F.trim(x)).alias("lines"))
    marked = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: (F.element_at("lines", i) == "#[test]") | F.element_at("lines", i).startswith("#[test("))
    each = rust.select("repo", "file", "lines", F.explode(marked).alias("at"))
    behind = F.transform(F.slice("lines", F.col("at") + 1, F.lit(4)), lambda x, i: F.struct(x.alias("line"), (i + F.col("at") + 1).alias("n")))
    first = F.get(F.filter(behind, lambda x: (x["line"] != "") & ~x["line"].startswith("#") & ~x["line"].startswith("//")), F.lit(0))
    named = each.select("repo", "file", first.alias("x")).select("repo", "file", found("x.line", r"^fn ([A-Za-z0-9_]+)").alias("symbol"), F.col("x.n").cast("int").alias("start_line"))
    return named.where("symbol is not null")


def script_functions(scripts: DataFrame) -> DataFrame:
    """Functions of inline scripts (repo, path, line, body) at their lines of the page."""
    files = scripts.select("repo", F.concat_ws("#", "path", F.col("line").cast("string"), F.lit("x.js")).alias("path"), F.col("body").alias("content"))
    f = functions(files)
    at = F.element_at(F.split("file", "#"), -2).cast("int") - 1
    return f.select("repo", F.regexp_replace("file", r"#\d+#x\.js$", "").alias("file"), "symbol", (F.col("start_line") + at).alias("start_line"), (F.col("end_line") + at).alias("end_line"), "cc")


def imports_of_python(files: DataFrame) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r, p, m, n) for r, p, c in zip(b.repo, b.path, b.content) for m, n in python_imports(c)]
            yield pd.DataFrame(rows, columns=["repo", "file", "module", "line"])

    some = files.where((paths.language_of("path") == "python") & F.contains("content", F.lit("import")))
    return some.select("repo", "path", "content").mapInPandas(read, "repo string, file string, module string, line int")


# First segments of paths that are no crates.
RUST_BUILTINS = ("std", "core", "alloc", "proc_macro", "test", "crate", "self", "super", "Self")
# End of fixed values.


def imports_of_rust(files: DataFrame) -> DataFrame:
    """First segments of `use` and `extern crate` lines, without built-in ones and modules of the same file."""
    f = files.where(paths.language_of("path") == "rust").select("repo", F.col("path").alias("file"), "content")
    own = f.select("repo", "file", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:mod|enum|struct|trait)\s+(\w+)"), F.lit(1))).alias("module")).distinct()
    name = found("line", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:use\s+(?:::)?|extern\s+crate\s+)(\w+)")
    rows = lines_of(f, "content", ["repo", "file"]).select("repo", "file", name.alias("module"), (F.col("pos") + 1).alias("line")).where(F.col("module").isNotNull() & ~F.col("module").isin(*RUST_BUILTINS))
    return rows.join(own, ["repo", "file", "module"], "left_anti").select("repo", "file", "module", "line")


def pub_items(files: DataFrame) -> DataFrame:
    """Public items of Rust files: kind and name."""
    p = r"(?m)^\s*(pub (?:async |unsafe |const )*(?:fn|struct|enum|trait|type|const|mod) \w+)"
    f = files.where(paths.language_of("path") == "rust").select("repo", F.col("path").alias("file"), F.explode(F.regexp_extract_all("content", F.lit(p), F.lit(1))).alias("i"))
    return f.select("repo", "file", F.element_at(F.split("i", " "), -2).alias("kind"), F.element_at(F.split("i", " "), -1).alias("name")).distinct()


def declared_deps(manifests: DataFrame) -> DataFrame:
    """repo, dir and module of the dependencies that manifests (repo, path, content) declare.

    Cargo tables and table headers, requirements files, and the dependency lists of pyproject, setup.cfg and
    setup.py files. Versions, extras and markers are cut off; names use underscores."""
    base = paths.basename("path")
    d = paths.dirname("path")
    keyed = manifests.select("repo", "path", F.when(d == "", ".").otherwise(d).alias("dir"), base.alias("base"), "content")
    l = lines_of(keyed, "content", ["repo", "path", "dir", "base"])
    l = carry(l.withColumn("line", F.regexp_replace("line", r"\s+#.*$|^#.*$", "")), ["repo", "path"], section=found("line", r"^\s*\[+\s*([^\]]+?)\s*\]+"))
    dep_section = F.col("section").rlike(r"(^|\.)(dependencies|dev-dependencies|build-dependencies)$")
    cargo = l.where(F.col("base") == "Cargo.toml")
    tables = cargo.where(dep_section & ~F.col("line").rlike(r"^\s*\[")).select("repo", "dir", found("line", r"^\s*\"?([A-Za-z0-9_-]+)\"?(?:\.[\w-]+)*\s*=").alias("module"))
    headers = cargo.select("repo", "dir", found("line", r"^\s*\[(?:.*\.)?(?:dependencies|dev-dependencies|build-dependencies)\.\"?([A-Za-z0-9_-]+)\"?\]").alias("module"))
    req = l.where(F.col("base").rlike(r"^requirements.*\.txt$") & ~F.col("line").rlike(r"^\s*-")).select("repo", "dir", found("line", r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)").alias("module"))
    poetry = l.where((F.col("base") == "pyproject.toml") & F.col("section").rlike(r"^tool\.poetry\.(.*\.)?(dependencies|dev-dependencies)$")).select("repo", "dir", found("line", r"^\s*\"?([A-Za-z0-9._-]+)\"?\s*=").alias("module")).where("module <> 'python'")
    cfg = l.where((F.col("base") == "setup.cfg") & (F.col("section") == "options") & F.col("line").rlike(r"^\s+[A-Za-z]")).select("repo", "dir", found("line", r"^\s+([A-Za-z0-9][A-Za-z0-9._-]*)").alias("module"))
    lists = keyed.where(F.col("base").isin("pyproject.toml", "setup.py")).select("repo", "dir", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)(?:dependencies|install_requires|requires)\s*=\s*\[(.*?)\]\s*(?:\n|$|,)"), F.lit(1))).alias("l"))
    quoted = lists.select("repo", "dir", F.explode(F.regexp_extract_all("l", F.lit(r"""["']([A-Za-z0-9][A-Za-z0-9._-]*)"""), F.lit(1))).alias("module"))
    out = tables
    for more in (headers, req, poetry, cfg, quoted):
        out = out.unionByName(more)
    return out.where("module is not null").select("repo", "dir", scoring.module_name("module").alias("module")).distinct()
