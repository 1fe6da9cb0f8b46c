"""Substring dedup by recompression: every word covered by a window of words that also starts earlier is removed.

Words get hashed names. Rounds rename runs of equal symbols and then pairs, a pair being a symbol of the left class
before one of the right class; classes and names are functions of the symbols alone, so they agree over the whole
corpus. Each symbol carries its context, the words that decide that it stands there. A window of words picks, among
the symbols whose context lies inside it, one of the highest round: a choice that depends on the window's words
only, so equal windows pick equal symbols in equal places. Neighbouring windows mostly pick the same one.

Contexts widen with every round, so three neighbouring symbols of the third round (two rounds of pairs after one of
runs) count as the highest: some five words with a context that a window holds in many places. Of those, a window
picks the one with the least hash, the first of equal ones. Where it holds none, it takes two, one, then earlier rounds;
single words are always there, so texts of equal or periodic words lose nothing.

1. Each text's picks become rows: the symbol's name, a hash of all the windows that pick it there, the place of the
   first of them. A batch sends equal rows once, with the other places beside it, so frequent passages arrive
   as a row per batch. One shuffle brings equal names together. Equal hashes behind a first one are repeats as a
   whole; the first ones are settled where the name has one hash, and open where other contexts share the symbol.
2. Windows of open places are compared one by one, by their own hashes; those that start later are repeats.
3. Repeated windows become ranges of words per document, and documents are written without them.

Names and window hashes come from the two halves of a 128-bit hash of the words and decide together, 128 bits in all.

A document's place in the order is its doc_id (nulls last), then a hash of its text. Rows that equal in doc_id and
text are one document, and each gets its result. A null text has no words, as has an empty one; documents of fewer
words than a window keep all. Texts count whole, however long. An empty table gives an empty one. Columns other than
doc_id and text play no part in the report, and come back unchanged from `remove_repeats`."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialize, runs

WINDOW = 20
_WORD = re.compile(WORD)
#: White space to Python alone.
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_M1, _M2, _S = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(31)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(63)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> _S)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text) if _ODD.search(text) else text.split()


def names_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The two 64-bit names of each word."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


class Level:
    """Symbols in a row: names, the words they stand for, the words that decide on them, and their documents."""

    __slots__ = ("name", "start", "left", "right", "doc")

    def __init__(self, *parts: np.ndarray):
        self.name, self.start, self.left, self.right, self.doc = parts

    def beside(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each symbol and the next share a document, and how far contexts reach that take in the symbol
        before, or after; at a document's edge they reach beyond it."""
        joined = self.doc[1:] == self.doc[:-1]
        before, after = np.empty_like(self.left), np.empty_like(self.right)
        before[1:], after[:-1] = self.left[:-1], self.right[1:]
        edge = np.flatnonzero(~joined)
        first, last = np.append(0, edge + 1), np.append(edge, len(self.name) - 1)
        before[first], after[last] = low[self.doc[first]] - 1, high[self.doc[last]] + 1
        return joined, before, after

    def runs(self, low: np.ndarray, high: np.ndarray) -> Level:
        """Runs of equal symbols renamed."""
        joined, before, after = self.beside(low, high)
        same = joined & (self.name[1:] == self.name[:-1])
        if not same.any():
            return Level(self.name, self.start, before, after, self.doc)
        first = np.flatnonzero(np.append(True, ~same))
        last = np.append(first[1:], len(self.name)) - 1
        n = (last - first + 1).astype(np.uint64)
        name = self.name[first]
        name = np.where(n == 1, name, mix(name * _GOLD + n))
        return Level(name, self.start[first], before[first], after[last], self.doc[first])

    def pairs(self, seed: np.uint64, low: np.ndarray, high: np.ndarray) -> Level:
        """Symbols of the left class before ones of the right class renamed together."""
        joined, before, after = self.beside(low, high)
        right = (self.name ^ seed) * _M1 >> _TOP == 1
        paired = joined & ~right[:-1] & right[1:]
        at = np.flatnonzero(paired)
        left, reach, name = np.where(right, before, self.left), np.where(right, self.right, after), self.name.copy()
        # a pair is decided by its two symbols alone
        reach[at], left[at] = self.right[at + 1], self.left[at]
        name[at] = mix(name[at] * _GOLD + self.name[at + 1])
        keep = np.append(True, ~paired)
        return Level(name[keep], self.start[keep], left[keep], reach[keep], self.doc[keep])

    def rows(self, width: int) -> Level:
        """Each `width` symbols in a row as one; those cut by a document's end have a context beyond it."""
        n = len(self.name) - width + 1
        if n <= 0:
            return Level(*(x[:0] for x in (self.name, self.start, self.left, self.right, self.doc)))
        name = self.name[:n]
        for k in range(1, width):
            name = mix(name * _GOLD + self.name[k : k + n])
        whole = self.doc[:n] == self.doc[width - 1 :]
        return Level(name[whole], self.start[:n][whole], self.left[:n][whole], self.right[width - 1 :][whole], self.doc[:n][whole])


def first_least(order: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The place of the least of order[low:high], the first of equal ones; ranges hold one place at least."""
    at, width = np.arange(len(order), dtype=np.int32), high - low
    out = np.empty(len(low), np.int32)
    step = 1
    while True:
        here = np.flatnonzero((width >= step) & (width < 2 * step))
        a, b = at[low[here]], at[high[here] - step]
        out[here] = np.where(order[b] < order[a], b, a)
        if width.max(initial=0) < 2 * step or len(at) <= step:
            return out
        a, b = at[:-step], at[step:]
        at = np.where(order[b] < order[a], b, a)
        step *= 2


def picks(names: np.ndarray, ends: np.ndarray, window: int = WINDOW, rounds: int = 3, width: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first words of all windows in a row of documents that end at `ends`, the name of the symbols that each
    window picks, and their first word."""
    ends = np.asarray(ends, np.int32)
    sizes = np.diff(ends, prepend=np.int32(0))
    low, high, n = ends - sizes, ends, len(names)
    place = np.arange(n, dtype=np.int32)
    doc = np.repeat(np.arange(len(ends), dtype=np.int32), sizes)
    fits = place[place + window <= high[doc]]
    level = Level(names, place, place, place + 1, doc)
    levels = [level]
    for k in range(rounds + 1):
        level = level.pairs(mix(np.array([k], np.uint64))[0], low, high) if k else level.runs(low, high)
        levels.append(level)
    levels += [level.rows(k) for k in range(2, width + 1)]
    name, start, todo = np.zeros(n, np.uint64), np.zeros(n, np.int32), fits
    for level in reversed(levels):
        if not len(todo):
            break
        if not len(level.name):
            continue
        before = np.cumsum(np.bincount(np.maximum(level.left, 0), minlength=n + 1))
        until = np.cumsum(np.bincount(np.maximum(level.right, 0), minlength=n + 2))
        outside = int((level.left < 0).sum())
        a = np.where(todo > 0, before[np.maximum(todo, 1) - 1], outside)
        b = until[todo + window]
        some = b > a
        here, at = todo[some], first_least(mix(level.name), a[some], b[some])
        name[here], start[here] = level.name[at], level.start[at]
        todo = todo[~some]
    return fits, name[fits], start[fits]


#: What each position of a hash of a window's words is multiplied by.
_PLACES = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD) | np.uint64(1)


def window_hashes(names: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A hash of each `window` words in a row."""
    n = max(0, len(names) - window + 1)
    out = np.zeros(n, np.uint64)
    for k in range(window):
        out += names[k : k + n] * (_PLACES[k] if k < len(_PLACES) else mix(np.array([k], np.uint64))[0])
    return mix(out)


#: A place: where the first window starts and how many windows follow each other, in one number.
_SHIFT = 16
_POS = np.dtype([("none", "?"), ("id", "<i8"), ("text_hash", "<i8"), ("place", "<i8")])
_ROWS = "name long, hash long, none boolean, id long, text_hash long, place long, more binary"


def _packed(name: np.ndarray, key: np.ndarray, pos: np.ndarray) -> pd.DataFrame:
    """One row for each name and hash with the first of its places, and the bytes of the others."""
    order = np.lexsort((pos["place"], pos["text_hash"], pos["id"], pos["none"], key, name))
    name, key, pos = name[order], key[order], pos[order]
    first = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (key[1:] != key[:-1])))
    last = np.append(first[1:], len(name))
    data, size = pos.tobytes(), pos.dtype.itemsize
    more = [data[(a + 1) * size : b * size] if b > a + 1 else None for a, b in zip(first.tolist(), last.tolist())]
    return pd.DataFrame({"name": name[first].view(np.int64), "hash": key[first].view(np.int64), **{c: pos[c][first] for c in _POS.names}, "more": more})


def _positions(b: pd.DataFrame, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    pos = np.empty(len(doc), _POS)
    for c in ("none", "id", "text_hash"):
        pos[c] = b[c].to_numpy()[doc]
    pos["place"] = place
    return pos


def _texts(b: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[list[str]]]]:
    for i, j in runs(b.text.tolist()):
        part = b.iloc[i:j]
        yield part, [words_of(t) for t in part.text]


def place_of(docs: DataFrame) -> tuple[dict[str, Column], bool]:
    """A document's place in the order: none, id, text_hash; and whether ids tell all rows apart: then the hash is 0."""
    once = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    text_hash = F.lit(0).cast("long") if once else F.xxhash64(F.coalesce("text", F.lit("")))
    return {"none": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)).cast("long"), "text_hash": text_hash}, once


def keyed(docs: DataFrame, own: dict[str, Column]) -> DataFrame:
    return docs.select(*[c.alias(name) for name, c in own.items()], F.coalesce("text", F.lit("")).alias("text"))


def repeated_windows(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """none, id, text_hash and places: of each document that has some, the runs of windows that start earlier, too.
    `rows` are keyed documents, each once."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, words in _texts(b):
                sizes = [len(w) for w in words]
                if max(sizes) < window:
                    continue
                low, high = names_of([x for w in words for x in w])
                ends = np.cumsum(sizes)
                at, name, start = picks(low, ends, window)
                hashes = window_hashes(high, window)
                first = np.flatnonzero(np.append(True, (start[1:] != start[:-1]) | (name[1:] != name[:-1]) | (at[1:] != at[:-1] + 1)))
                last = np.append(first[1:], len(at)) - 1
                n = last - first + 1
                apart = (start[first] - at[first]).astype(np.uint64) << np.uint64(_SHIFT) | n.astype(np.uint64)
                key = mix(hashes[at[first]] ^ mix(hashes[at[last]] * _GOLD + apart))
                doc = np.searchsorted(ends, at[first], "right")
                began = at[first] - (ends - sizes)[doc]
                yield _packed(name[first], key, _positions(part, doc, began.astype(np.int64) << _SHIFT | n))

    order = [F.col(c) for c in ("none", "id", "text_hash", "place")]
    by_name = Window.partitionBy("name")
    seen = rows.mapInPandas(pick, _ROWS)
    seen = seen.select("*", F.lag("hash").over(by_name.orderBy("hash", *order)).alias("before"), (F.min("hash").over(by_name) != F.max("hash").over(by_name)).alias("shared"))
    first = F.col("before").isNull() | (F.col("before") != F.col("hash"))
    seen = materialize(seen.select("name", "none", "id", "text_hash", "place", "more", first.alias("first"), "shared").where("not first or shared or more is not null"), "picked")

    own = ["none", "id", "text_hash"]
    open_ = seen.where("first and shared").groupBy(*own).agg(F.collect_list(F.struct("name", "place")).alias("open"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, words in _texts(b):
                sizes = [len(w) for w in words]
                hashes = window_hashes(names_of([x for w in words for x in w])[1], window)
                begins = np.cumsum(sizes) - sizes
                doc = np.repeat(np.arange(len(part)), part.open.str.len())
                name = np.array([x["name"] for some in part.open for x in some], np.int64)
                place = np.array([x["place"] for some in part.open for x in some], np.int64)
                n = place & ((1 << _SHIFT) - 1)
                each = np.repeat(np.arange(len(doc)), n)
                at = (place >> _SHIFT)[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                yield _packed(name[each].view(np.uint64), hashes[begins[doc[each]] + at], _positions(part, doc[each], at << _SHIFT | 1))

    alike = rows.join(open_, own).mapInPandas(compare, _ROWS)
    alike = alike.withColumn("before", F.lag("hash").over(Window.partitionBy("name", "hash").orderBy(*order)))
    alike = materialize(alike.select(*own, "place", "more", F.col("before").isNull().alias("first")).where("not first or more is not null"), "windows")

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            later = b[~b["first"]]
            yield later[["none", "id", "text_hash", "place"]]
            more = np.frombuffer(b"".join(x for x in b.more if x is not None), _POS)
            yield pd.DataFrame({c: more[c] for c in _POS.names})

    found = seen.select(*own, "place", "more", "first").unionByName(alike).mapInPandas(places, "none boolean, id long, text_hash long, place long")
    return found.groupBy(*own).agg(F.collect_list("place").alias("places"))


def _kept(words: list[str], places: np.ndarray | None, window: int) -> list[str]:
    """The words that no window at these places covers."""
    if places is None or not len(places):
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    start = np.asarray(places) >> _SHIFT
    np.add.at(steps, start, 1)
    np.add.at(steps, start + (np.asarray(places) & ((1 << _SHIFT) - 1)) + window - 1, -1)
    out = np.cumsum(steps[:-1]) == 0
    return [words[i] for i in np.flatnonzero(out)]


def repeats_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row, the hash being that of the kept words in a row."""

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, places in zip(b.text, b.places):
                words = words_of(text)
                kept = _kept(words, places, window)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
            n, removed, digest = zip(*out) if out else ((), (), ())
            yield pd.DataFrame({"none": b.none, "id": b.id, "n_words": n, "n_removed": removed, "kept_sha256": digest})

    own = ["none", "id", "text_hash"]
    columns, once = place_of(docs)
    rows = keyed(docs, columns)
    rows = rows.join(repeated_windows(rows if once else rows.dropDuplicates(own), window), own, "left")
    rows = rows.mapInPandas(report, "none boolean, id long, n_words long, n_removed long, kept_sha256 string")
    return rows.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, in their own columns, with each text's kept words in a row; texts that lose none stay as they are."""

    @F.pandas_udf("string")
    def cleaned(text: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([t if p is None or t is None else " ".join(_kept(words_of(t), p, window)) for t, p in zip(text, places)], dtype=object)

    own, once = place_of(docs)
    rows = keyed(docs, own)
    named = {c: f"_{c}_of_row" for c in (*own, "places")}
    found = repeated_windows(rows if once else rows.dropDuplicates(list(own)), window).withColumnsRenamed(named)
    rows = docs.withColumns({named[c]: value for c, value in own.items()}).join(found, [named[c] for c in own], "left")
    return rows.withColumn("text", cleaned("text", named["places"])).select(*docs.columns)
