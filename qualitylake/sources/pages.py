"""Pages as elements: one parse per page, spread over the cluster by page."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags whose end may be left out, and tags without an end.
OPTIONAL_END = frozenset("html head body li dt dd p rt rp optgroup option colgroup caption thead tbody tfoot tr td th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# End of fixed values.

#: Elements whose text the rules read; a parse for rules alone may leave that of others empty.
RULE_TEXT = frozenset("a button title style label option h1 h2 h3 h4 h5 h6".split())
RAW = frozenset(("script", "style", "textarea", "title"))

ELEMENT = "struct<pos:int,name:string,line:int,col:int,attrs:array<struct<k:string,v:string>>,text:string>"
BALANCE = "struct<rule:string,line:int,col:int,message:string>"

#: Both as lists of Arrow's.
_ATTRS = pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())]))
_ELEMENTS = pa.list_(pa.struct([("pos", pa.int32()), ("name", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("attrs", _ATTRS), ("text", pa.string())]))
_BALANCE = pa.list_(pa.struct([("rule", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("message", pa.string())]))


class _Reader(HTMLParser):
    def __init__(self, text_of: frozenset[str] | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.text_of = text_of
        self.elements: list[dict] = []
        self.balance: list[dict] = []
        self.doctype = False
        self.stack: list[tuple[str, int, int, dict]] = []
        self.open_texts: list[dict] = []

    def handle_decl(self, decl: str) -> None:
        self.doctype = self.doctype or decl.lower().startswith("doctype html") or decl.lower().startswith("doctype")

    def _has_text(self, tag: str) -> bool:
        return self.text_of is None or tag in self.text_of

    def _element(self, tag: str, attrs: list) -> dict:
        line, col = self.getpos()
        e = {"pos": len(self.elements), "name": tag, "line": line, "col": col + 1, "attrs": [{"k": k, "v": v or ""} for k, v in attrs] if attrs else [], "text": []}
        self.elements.append(e)
        return e

    def handle_starttag(self, tag: str, attrs: list) -> None:
        e = self._element(tag, attrs)
        if tag not in VOID:
            self.stack.append((tag, e["line"], e["col"], e))
            if self._has_text(tag):
                self.open_texts.append(e)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        top = self.stack[-1][0] if self.stack else ""
        if top in ("script", "style"):
            if top == "style":
                self.stack[-1][3]["text"].append(data)
            return
        for e in self.open_texts:
            e["text"].append(data)

    def _pop(self) -> tuple:
        entry = self.stack.pop()
        if self._has_text(entry[0]):
            self.open_texts.pop()
        return entry

    def _report(self, rule: str, line: int, col: int, message: str) -> None:
        self.balance.append({"rule": rule, "line": line, "col": col, "message": message})

    def _unclosed(self, entry: tuple) -> None:
        if entry[0] not in OPTIONAL_END and entry[0] not in RAW:
            self._report("html.unclosed", entry[1], entry[2], f"unclosed <{entry[0]}>")

    def handle_endtag(self, tag: str) -> None:
        if self.stack and self.stack[-1][0] == tag:
            self._pop()
            return
        line, col = self.getpos()
        if any(entry[0] == tag for entry in self.stack):
            while self.stack[-1][0] != tag:
                self._unclosed(self._pop())
            self._pop()
        self._report("html.misnested", line, col + 1, f"misnested </{tag}>")

    def finish(self) -> None:
        self.close()
        for entry in self.stack:
            self._unclosed(entry)
        for e in self.elements:
            e["text"] = "".join(e["text"])


def parse_page(html: str | None, text_of: frozenset[str] | None = None) -> tuple[bool, list[dict], list[dict]]:
    reader = _Reader(text_of)
    reader.feed(html or "")
    reader.finish()
    return reader.doctype, reader.elements, reader.balance


def mask_jsx(code: str) -> str:
    """Expressions in braces become a quoted x, unless they hold markup."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(code):
        if ch == "{":
            if depth == 0:
                out.append(code[start:i])
                start = i
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if depth == 0:
                inner = code[start : i + 1]
                out.append(inner if "<" in inner else '"x"')
                start = i + 1
    out.append(code[start:])
    return "".join(out)


def _in_runs(batches: Iterator[pd.DataFrame], pages: int = 64, chars: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Batches cut into runs of at most `pages` pages and, but for single ones, `chars` characters: elements take many
    times the space of their page, so a worker holds those of one run only."""
    for b in batches:
        ends = b.html.str.len().fillna(0).cumsum().tolist()
        at = 0
        while at < len(b):
            before = ends[at - 1] if at else 0
            to = max(at + 1, min(at + pages, bisect_right(ends, before + chars)))
            yield b.iloc[at:to]
            at = to


def parse_pages(pages: DataFrame, jsx: bool = False, text_of: frozenset[str] | None = None) -> DataFrame:
    """page_id, url, has_doctype, elements and balance of pages (page_id, url, html). Every element holds its visible
    text, that of elements inside it too; with `text_of` only these elements hold theirs, so rows stay as small as pages."""

    def rows(batches: Iterator[pa.RecordBatch], size: int = 64) -> Iterator[pd.DataFrame]:
        """Pages a few at a time, so that of a batch of Spark's (64 MB) no second copy is held as strings."""
        for b in batches:
            for at in range(0, b.num_rows, size):
                yield b.slice(at, size).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)  # ids stay whole beside null ones

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _in_runs(rows(batches)):
            found = [parse_page(mask_jsx(h or "") if jsx else h, text_of) for h in b.html]
            columns = {"page_id": pa.array(b.page_id, pa.int64()), "url": pa.array(b.url, pa.string()), "has_doctype": pa.array([x[0] for x in found], pa.bool_()), "elements": pa.array([x[1] for x in found], _ELEMENTS), "balance": pa.array([x[2] for x in found], _BALANCE)}
            yield pa.RecordBatch.from_pydict(columns)

    read = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return read.mapInArrow(parse, f"page_id long, url string, has_doctype boolean, elements array<{ELEMENT}>, balance array<{BALANCE}>")


def page_elements(parsed: DataFrame) -> DataFrame:
    """One row per element, in page order."""
    return parsed.select("page_id", "url", F.inline("elements"))


def inline_scripts(pages: DataFrame) -> DataFrame:
    """page_id, line and body of scripts without a source, by splitting text; no parse is needed."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)(<script(?![^>]*src=)[^>]*>.*?)(?:</script>|$)"), F.lit(1))
    # each script is looked for behind the one before it, so equal scripts have their own places
    places = F.expr("aggregate(found, named_struct('next', 1, 'at', cast(array() as array<int>)), (s, x) -> named_struct('next', locate(x, html, s.next) + char_length(x), 'at', array_append(s.at, locate(x, html, s.next))), s -> s.at)")
    placed = pages.select("page_id", "html", found.alias("found")).withColumn("places", places)
    rows = placed.select("page_id", "html", F.posexplode(F.arrays_zip("found", "places")).alias("n", "z")).select("page_id", "html", "n", F.col("z.found").alias("whole"), F.col("z.places").alias("at"))
    body = F.regexp_replace("whole", "(?s)^[^>]*>", "")
    line = F.length(F.regexp_replace(F.left("html", F.col("at")), "[^\n]", "")) + 1
    return rows.select("page_id", "n", line.cast("int").alias("line"), body.alias("body")).where(F.trim("body") != "")
