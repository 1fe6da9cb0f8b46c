"""Main text of web pages: flat text blocks classified by a decision tree.

A page becomes blocks of text between block-level tags. A block's features are its word count and link density,
those of the blocks beside it, and how many blocks away the next long block with few links stands on either side.
A decision tree decides by these; where a leaf is still mixed it may also ask three hints: whether the block is a
heading, whether it stands inside an article, and whether inside an area that by its tag or name is a menu,
footer, sidebar, notice, advert, form or comment. The tree is grown from the labelled table in html_layouts.py
when the operator is called. Blocks that it accepts are joined in page order.

Null and empty pages, and pages without main text, give an empty text. Very long pages are read whole. Repeated
rows and rows with null ids are kept one by one; an empty table gives an empty table; columns other than
page_id, url and html play no part."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_layouts import filled_pages

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(script|style|textarea|iframe)(?=[\s/>])[^>]*(?<!/)>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.DOTALL | re.IGNORECASE,
)
#: Elements that are dropped with their content where their end tag is found; comments and raw text hold no tags.
DROPPED = frozenset("template svg select button canvas audio video".split())
_ENDS = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|iframe)(?=[\s/>])[^>]*(?<!/)>.*?(?:</\1\s*>|\Z)|<(/?)(" + "|".join(sorted(DROPPED)) + r")(?=[\s/>])[^>]*(?<!/)>",
    re.DOTALL | re.IGNORECASE,
)
_MATH = "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mspace mstyle mpadded mphantom menclose mfenced mtable mtr mtd semantics annotation"
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr object noscript".split()) | frozenset(_MATH.split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AREAS = frozenset("nav footer aside menu dialog".split())
ENCLOSING = AREAS | frozenset("form fieldset div section article main header ul ol dl table tbody thead tfoot tr td th figure blockquote body head title details center".split())
_NAMED = re.compile(r"""(?:class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
#: Words in class, id or role names of areas around the main text.
_AROUND = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|widget|nav|navbar|navigation|menu|breadcrumbs?|toolbar|topbar|footer|comments?(?:list|area|form|section|thread|body|box|wrap)?|respond|replies|disqus|cookies?|consent|gdpr|notices?|alert|popup|modal|share|sharing|social|related|newsletter|subscribe|signup|login|search|pagination|pager|copyright|disclaimer|contentinfo|complementary)(?![a-z])"
)
#: Names of page heads, which are areas outside of articles only; headings in them may be the article's.
_HEADER = re.compile(r"(?:^|[^a-z])(?:header|masthead)(?![a-z])")
_MAIN = re.compile(r"(?:^|[^a-z])(?:article|main|post-?body|entry-?content|story-?body|articlebody)(?![a-z])")
#: Names of layout containers that tell which areas a page has, not that they are one.
_LAYOUT = re.compile(r"^(?:with|has|no|without)[-_]|[-_](?:open|opened|closed|enabled|disabled|visible|hidden|free)$|(?:content|main|layout).*[-_]wrap(?:per)?$")
#: Areas that hold articles which are not the main text.
_OTHERS = re.compile(r"(?:^|[^a-z])(?:comments?(?:list|area|form|section|thread|body|box|wrap)?|respond|disqus|related|widget|promo\w*|sponsor\w*)(?![a-z])")
#: Names of areas that hold links and fields, not prose.
_FIELDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs toolbar topbar search login signup pagination pager share sharing social".split())
#: Areas that hold prose of readers or advertisers, whatever else is in their name.
_FOREIGN = re.compile(r"(?:^|[^a-z])(?:comments?(?:list|area|form|section|thread|body|box|wrap)?|respond|disqus|promo\w*|sponsor\w*|ads?|advert\w*)(?![a-z])")
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "long_before", "long_after", "heading", "article", "around")
#: How many of them are the method's own; the others are hints.
TEXTUAL = 8
#: What counts as a long block, and how far away it is looked for.
LONG, LINKED, FAR = 15, 0.3, 9
#: The level of an area inside of an article that its name alone makes, and not firmly; see soft.
SOFT = 1.5


def area(named: str) -> int:
    """0 for names of no area around the main text, 1 for a page head, 2 where a part of a name is an area, 3 where a
    whole name is one or the area may hold articles of its own."""
    level = 0
    for name in named.split():
        if _LAYOUT.search(name):
            continue
        if m := _AROUND.search(name):
            level = max(level, 3 if m[0] == name or _OTHERS.search(name) else 2)
        elif _HEADER.search(name):
            level = max(level, 1)
    return level


def soft(named: str) -> bool:
    """Whether names speak of areas only in part, or of areas that hold no prose: inside of an article that is no
    reason against a long block with few links."""
    names = [n for n in named.split() if _AROUND.search(n) and not _LAYOUT.search(n)]
    return all(n in _FIELDS or (_AROUND.search(n)[0] != n and not _FOREIGN.search(n)) for n in names)


def ends(page: str) -> dict[int, int]:
    """Where each dropped element that is closed starts, and where its end tag ends."""
    found: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for m in _ENDS.finditer(page):
        if m[3]:
            starts = opened.setdefault(m[3].lower(), [])
            if not m[2]:
                starts.append(m.start())
            elif starts:
                found[starts.pop()] = m.end()
    return found


def blocks(page: str) -> list[tuple[str, int, float, int, int, int]]:
    """Text, words, link density, heading, article and around of each block in page order. A form is an area
    around the main text unless it is outside of an article and holds more than half of the page's words."""
    out: list[tuple[str, int, float, int, int, int, int]] = []
    parts: list[str] = []
    linked: list[str] = []
    open_tags: list[tuple[str, int, float, int]] = []  # name, inside an article, inside an area around it (see area), form
    in_link, heading, article, around, form, forms = False, 0, 0, 0, 0, 0

    def close() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                n = text.count(" ") + 1
                k = len(" ".join(linked).split())
                beside = around > heading and not (around == SOFT and n >= LONG and k < LINKED * n)
                out.append((text, n, min(1.0, k / n), heading, article, int(beside), form))
            parts.clear()
            linked.clear()

    def take(piece: str) -> None:
        if piece:
            if "&" in piece:
                piece = html.unescape(piece)
            parts.append(piece)
            if in_link:
                linked.append(piece)

    at, dropped = 0, ends(page)
    while m := _TAG.search(page, at):
        take(page[at : m.start()])
        at = m.end()
        if m.start() in dropped:
            at = dropped[m.start()]
            parts.append(" ")
            continue
        name = (m[3] or m[6] or "").lower()
        if not name:
            if m[1]:
                parts.append(" ")
            continue
        closing = bool(m[2] or m[5])
        if name == "a":
            in_link = not closing
        if name in INLINE:
            if name in ("br", "object", "noscript"):
                parts.append(" ")
            continue
        close()
        in_link = False
        if name in HEADINGS:
            heading = 0 if closing else 1
            continue
        heading = 0
        if name in VOID or name not in ENCLOSING:
            continue
        if closing:
            k = next((i for i in range(len(open_tags) - 1, -1, -1) if open_tags[i][0] == name), None)
            if k is not None:
                del open_tags[k:]
        else:
            named = " ".join(x.strip("\"'") for x in _NAMED.findall(m[4] or m[7] or "")).lower()
            art = int(article or name in ("article", "main") or (bool(named) and _MAIN.search(named) is not None))
            own = 0 if name in ("body", "article", "main", "form") else area(named)
            main = name in ("article", "main") or _MAIN.search(named) is not None
            if name in AREAS or (name == "header" and not article) or (name == "form" and article) or name in ("head", "title"):
                own = 3
            elif own == 1 and article:
                own = 0
            elif own > 1 and article and soft(named):
                own = SOFT
            elif main and not own and (around < 3 or name == "main"):
                around = 0
            if name == "form":
                forms += 1
                form = forms
            open_tags.append((name, art, max(around, own), form))
        article, around, form = open_tags[-1][1:] if open_tags else (0, 0, 0)
    take(page[at:])
    close()
    within = [0] * (forms + 1)
    for b in out:
        within[b[6]] += b[1]
    small = [f > 0 and 2 * n <= sum(within) for f, n in enumerate(within)]
    return [(*b[:5], int(b[5] or small[b[6]])) for b in out]


def features(found: list[tuple]) -> list[tuple[float, ...]]:
    """A row of FEATURES per block. Distances to long blocks end at FAR."""
    none = ("", 0, 0.0)

    def distances(run: list[tuple]) -> list[int]:
        out, away = [], FAR
        for b in run:
            out.append(away)
            away = 1 if b[1] >= LONG and b[2] < LINKED else min(FAR, away + 1)
        return out

    before, after = distances(found), distances(found[::-1])[::-1]
    beside = zip([none, *found[:-1]], found, [*found[1:], none], before, after)
    return [(b[1], b[2], p[1], p[2], n[1], n[2], u, v, b[3], b[4], b[5]) for p, b, n, u, v in beside]


def labelled_rows(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of pages of the labelled table; text that starts with m is main text."""
    rows, marks = [], []
    for page in pages:
        found = blocks(page)
        rows += features(found)
        marks += [b[0].startswith("m") for b in found]
    return np.array(rows, float), np.array(marks)


#: A leaf is True or False; a node is (feature, threshold, at most, above).
Tree = bool | tuple


def _best_cut(x: np.ndarray, y: np.ndarray, least: int) -> tuple[float, int, float] | None:
    """Impurity, feature and threshold of the best cut that leaves `least` rows on each side."""
    best, n = None, len(y)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, k = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        at = at[(at >= least) & (n - at >= least)]
        if not len(at):
            continue
        low, high = k[at - 1] / at, (k[-1] - k[at - 1]) / (n - at)
        impurity = 2 * (at * low * (1 - low) + (n - at) * high * (1 - high))
        i = int(impurity.argmin())
        if best is None or impurity[i] < best[0] - 1e-12:
            best = float(impurity[i]), f, float((v[at[i]] + v[at[i] - 1]) / 2)
    return best


def grow(x: np.ndarray, y: np.ndarray, textual: int = 4, hinted: int = 8, least: int = 10) -> Tree:
    """A decision tree by the largest decrease of Gini impurity; ties go to the first feature and lowest cut.

    Its first `textual` levels ask the textual features only, with `least` rows in a leaf; up to `hinted` levels
    below them, where a leaf is still mixed, may ask everything."""
    if y.all() or not y.any() or not textual + hinted:
        return bool(2 * y.sum() > len(y))
    p = y.mean()
    if textual:
        cut = _best_cut(x[:, :TEXTUAL], y, least)
        if cut is None or cut[0] > 2 * len(y) * p * (1 - p) - 1e-9:
            return grow(x, y, 0, hinted, 2)
    else:
        cut = _best_cut(x, y, 2)
        if cut is None or cut[0] > 2 * len(y) * p * (1 - p) - 1e-9:
            return bool(2 * y.sum() > len(y))
    _, f, at = cut
    low = x[:, f] <= at
    deeper = (textual - 1, hinted) if textual else (0, hinted - 1)
    return f, at, grow(x[low], y[low], *deeper, least), grow(x[~low], y[~low], *deeper, least)


@lru_cache(maxsize=1)
def trained_tree() -> Tree:
    return grow(*labelled_rows(filled_pages()))


def accepts(tree: Tree, row: tuple[float, ...]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    return "\n".join(b[0] for b, row in zip(found, features(found)) if accepts(tree, row))


def extract_text(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    tree = trained_tree() if tree is None else tree

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(p, tree) for p in b.html]
            yield pd.DataFrame({"page_id": b.page_id, "url": b.url, "text": texts, "n_chars": np.array([len(t) for t in texts], "i8")})

    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    return rows.mapInPandas(extract, "page_id string, url string, text string, n_chars long").withColumn("page_id", F.col("page_id").cast("long"))
