"""Secret spans by fixed patterns and by dictionary-primed zstandard novelty.

Patterns give the base spans. Novelty adds more: a candidate is a long run of key-like characters with a
sensitive word close before it; its marginal size is what it adds to the compressed size of the text around it,
under a dictionary of code, identifiers and the corpus's own words (see corpus_words). Known text and repeated text
cost little there, words cost nothing; a key costs about a byte a character, and is reported.

Null and empty texts have no spans. Very long texts are read whole. Repeated rows and rows with null ids are
kept one by one; an empty table gives an empty table; other columns are untouched."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs below 24 characters are dropped, and no longer run holds a shorter match, so only long ones are looked for.
HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"auth|bearer|credential|private|passphrase|passwd|password|pwd|secret|token|(?:api|access|encryption|signing|license)[ _-]?key|signature|cookie", re.IGNORECASE | re.ASCII)

#: Text that code and configuration are full of; primes the compressor.
CODE = """
import from return function class def public private static final void const let var new this self
string integer boolean float double number object array list dict map set null none true false undefined
if else elif for while switch case break continue try except catch finally throw raise with as async await
client_id client_secret access_token refresh_token authorization bearer basic content-type application/json
username user_id email address account session cookie request response header headers params query body
password passwd passphrase secret token api_key apikey key value name host port url uri path file config
settings environment export process.env os.environ getenv localhost example.com http:// https:// www.
database connection server service endpoint region bucket project default example placeholder changeme
your_api_key_here your-token-here insert_key_here abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789
"""


#: Runs of letters that may be words; camel case begins a new one.
WORD = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}")


class Novelty:
    """Marginal compressed bytes of a candidate behind its surroundings, with words of the corpus as dictionary.

    Runs of letters that read like words cost nothing, known or not: their letters follow each other as in the
    dictionary's words, within `plain` bits a letter (words mostly take 3 to 4.5, random letters 5 and more)."""

    def __init__(self, words: tuple[str, ...] = (), around: int = 512, plain: float = 5.0):
        dictionary = " ".join(words[::-1]) + CODE  # what is frequent stands near the end
        self.size = zstandard.ZstdCompressor(9, dict_data=zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False)
        self.around, self.plain = around, plain
        self.bits = [self._bits(known) for known in (re.findall(r"[a-z]{3,}", CODE.lower()), [w for w in words if re.fullmatch("[a-z]+", w)]) if known]

    @staticmethod
    def _bits(words: Iterable[str]) -> list[list[float]]:
        """Bits of a letter behind another, 0 for the start of a word."""
        pairs = np.full((27, 27), 0.05)
        for w in words:
            for x, y in zip("`" + w, w):
                pairs[ord(x) - 96, ord(y) - 96] += 1
        return (-np.log2(pairs / pairs.sum(axis=1, keepdims=True))).tolist()

    def wordlike(self, run: str) -> bool:
        run = run.lower()
        return any(sum(bits[ord(x) - 96][ord(y) - 96] for x, y in zip("`" + run, run)) <= self.plain * len(run) for bits in self.bits)

    def ratio(self, text: str, start: int, end: int) -> float:
        """Copies of the candidate around it, whole or cut, are left out, lest they make it look like known text."""
        value, n = text[start:end], end - start
        low, high = max(0, start - self.around), min(len(text), end + self.around)
        if (k := text.rfind(value, max(0, low - n + 1), min(start, low + n - 1))) >= 0:
            low = k + n
        if (k := text.find(value, max(end, high - n + 1), high + n - 1)) >= 0:
            high = k
        context = (text[low:start].replace(value, " ") + "\n" + text[end:high].replace(value, " ") + "\n").encode("utf-8", "replace")
        left = WORD.sub(lambda m: " " if self.wordlike(m[0]) else m[0], value)
        if not (left := " ".join(left.split())):
            return 0.0
        return (len(self.size.compress(context + left.encode())) - len(self.size.compress(context))) / n


@lru_cache(maxsize=2)
def novelty(words: tuple[str, ...] = ()) -> Novelty:
    return Novelty(words)


def corpus_words(docs: DataFrame, most: int = 8_000) -> tuple[str, ...]:
    """The words that stand in two different texts of the corpus or more: the `most` that stand in most rows, by that
    number. Every whole text is counted. Whether a word's texts differ is told by the least and the largest hash of
    them, so only words with three numbers move, one row a word and task."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![a-z])([a-z]{4,24})(?![a-z])")))
    each = docs.where(F.length("text") > 0).select(F.xxhash64("text").alias("h"), F.explode(words).alias("word"))
    top = each.groupBy("word").agg(F.count("*").alias("n"), F.min("h").alias("first"), F.max("h").alias("last")).where("first < last").orderBy(F.desc("n"), "word").limit(most)
    return tuple(r["word"] for r in top.collect())  # `most` words at most


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the pattern matches, leftmost and non-overlapping in each kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def novel_spans(text: str, base: list[tuple[str, int, int]], threshold: float = 0.75, reach: int = 48, words: tuple[str, ...] = ()) -> list[tuple[str, int, int, float]]:
    """Incompressible strings close behind a sensitive word, and their other occurrences, that no base span covers."""
    starts = sorted((a, b) for _, a, b in base)
    reached = list(accumulate((b for _, b in starts), max))  # the farthest end of the spans up to each

    def covered(s: int, e: int) -> bool:
        before = bisect_left(starts, (e, 0))  # spans that start before e
        return before > 0 and reached[before - 1] > s

    novel: dict[str, float] = {}
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        if novel.get(m[0], 0.0) < threshold and SENSITIVE.search(text, max(0, s - reach), s) and not covered(s, e):
            novel[m[0]] = novelty(words).ratio(text, s, e)
    found = {v for v, r in novel.items() if r >= threshold}
    return [("novel", *m.span(), novel[m[0]]) for m in CANDIDATE.finditer(text) if m[0] in found and not covered(*m.span())] if found else []


def spans(text: str, threshold: float = 0.75, words: tuple[str, ...] = ()) -> list[tuple[str, int, int, float | None]]:
    """All spans by start, then kind as listed."""
    base = base_spans(text)
    found = [(*b, None) for b in base] + novel_spans(text, base, threshold, words=words)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def find_secrets(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """doc_id and `found`: kind, start, end (code points, end exclusive), the matched text, and a novel span's ratio."""

    words = docs.sparkSession.sparkContext.broadcast(corpus_words(docs))  # 8,000 words at most

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e, "value": t[s:e], "ratio": r} for k, s, e, r in spans(t, threshold, words.value)] for t in b.text]
            yield pd.DataFrame({"doc_id": b.doc_id, "found": found})

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.mapInPandas(scan, "doc_id string, found array<struct<kind:string,start:int,end:int,value:string,ratio:double>>")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def span_text(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Counts, the digest of the base spans, and all spans of each document."""
    f = F.col("found")

    def count(kind: str) -> Column:
        return F.size(F.filter(f, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(f, lambda x: x["kind"] != "novel")
    return find_secrets(docs, threshold).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(f).alias("spans"), count("novel"))


def redact(docs: DataFrame, threshold: float = 0.75, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret replaced by a mark (of an assignment only the value); n_chars follows the text."""

    words = docs.sparkSession.sparkContext.broadcast(corpus_words(docs))  # 8,000 words at most

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for kind, s, e, _ in spans(text, threshold, words.value):
            if kind == "assign":
                s = s + ASSIGN.match(text[s:e]).start(2)
            if e > at:
                out += [text[at : max(at, s)], mark] if s >= at else [""]
                at = e
        return "".join(out) + text[at:] if out else text

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return pd.Series([clean(t) for t in texts], dtype=object)

    out = docs.withColumn("text", cleaned("text"))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))) if "n_chars" in docs.columns else out
