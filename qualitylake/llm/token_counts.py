"""Token counts by a finite-state transducer compiled from a byte-fallback BPE vocabulary.

A prefix's encoding is a chain of last tokens: it ends with the one piece whose pair with the encoding before it
survives the merges unchanged. So what the next character needs is only the longest suffix that starts some
piece, with the last token and relative count at each place in it: a finite state. Transitions carry the change
of the token count; states are compiled when first met. Where two neighbouring characters stand together in no
piece the encoding always breaks and the state is the start again.

A long text is cut into chunks that any task may read. A chunk's map takes an entry state to its exit state and
the tokens emitted. The entry is known where the characters before the chunk hold a break, and else assumed to be
what a run over them reaches from the start. Exits that the next chunk has not been entered by are entries still
missing; they are run, all chunks at once, until none is missing. Then the maps of neighbours compose, by fixed
numbers of chunks a level, to one map a text: a parallel prefix scan. States travel as text, so tasks need not
share what they compiled.

Null and empty texts have 0 tokens and 0 bytes. Rows are kept one by one, whatever repeats, with null ids too;
columns other than doc_id and text play no part. An empty table gives an empty table."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, one_per_worker, tokenizer_path

SPACE = "▁"
LONGEST = 1 << 16
BREAK = re.compile(f"[^{SPACE}\n][{SPACE}\n]")


class CountTransducer:
    """Counts tokens of texts; states, words and the characters in them are bounded, and compiled anew when dropped."""

    def __init__(self, path: str, states: int = 300_000, words: int = 1_000_000, chars: int = 32_000_000):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_byte(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in normal}
        self.prefixes = {p[:k] for p in self.score for k in range(1, len(p) + 1)}
        self.inside = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        # units for the word table: white space opens a word, a new line stands alone
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.score):
            raise ValueError("pieces of this vocabulary go on after white space")
        self.units = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.max_states, self.max_words, self.max_chars = states, words, chars
        self._reset()

    #: The name of the start state.
    START = json.dumps(["", [["", 0]]])

    def _reset(self) -> None:
        #: A state: the suffix, and for each place in it, from its end, the last token there and the tokens since.
        self.keys: list[tuple] = [("", (("", 0),))]
        self.ids = {self.keys[0]: 0}
        self.next: list[dict[str, tuple[int, int]]] = [{}]
        self.word: dict[str, int] = {}
        self.chars = 0
        self.pairs.clear()

    def merges(self, text: str) -> list[str]:
        """The library's merges: best score first, then leftmost; characters outside the vocabulary stand alone."""
        parts, score, none = list(text), self.score.get, -float("inf")
        gains = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while gains and (best := max(gains)) != none:
            i = gains.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gains[i]
            if i:
                gains[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(gains):
                gains[i] = score(parts[i] + parts[i + 1], none)
        return parts

    def tokens_of(self, piece: str) -> int:
        """A character that is no piece comes out as its bytes."""
        return 1 if piece in self.score else len(piece.encode("utf-8", "surrogatepass"))

    def _fits(self, last: str, piece: str) -> bool:
        if last == "":
            return self.merges(piece) == [piece]
        key = (last, piece)
        if (known := self.pairs.get(key)) is None:
            known = self.pairs[key] = self.merges(last + piece) == [last, piece]
        return known

    def _compile(self, state: int, c: str) -> tuple[int, int]:
        suffix, places = self.keys[state]
        text = suffix + c
        for size in range(len(text), 0, -1):
            piece = text[len(text) - size :]
            if (piece in self.score or size == 1) and (at := places[size - 1]) and self._fits(at[0], piece):
                break
        else:
            raise AssertionError("a prefix always has an encoding")
        emitted = self.tokens_of(piece) - at[1]
        kept = next((k for k in range(len(text), 0, -1) if text[len(text) - k :] in self.prefixes), 0)
        # a place is needed only while what follows it starts some piece
        new = [(piece, 0)]
        for k in range(1, kept + 1):
            new.append((places[k - 1][0], places[k - 1][1] + emitted) if text[len(text) - k :] in self.prefixes else None)
        key = (text[len(text) - kept :], tuple(new))
        if key not in self.ids:
            self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.next.append({})
        found = self.next[state][c] = (self.ids[key], emitted)
        return found

    def run(self, text: str, state: int = 0) -> tuple[int, int]:
        """The state after a text and the tokens it adds."""
        total = 0
        for c in text:
            step = self.next[state].get(c) or self._compile(state, c)
            state = step[0]
            total += step[1]
        return state, total

    def count(self, text: str) -> int:
        """The tokens of a text that starts at a break."""
        word = self.word
        units = self.units.findall(text)
        try:
            return sum(map(word.__getitem__, units))
        except KeyError:
            new = set(units).difference(word)
            long = {u: self.run(u)[1] for u in new if len(u) > 256}  # too long to keep
            for u in new.difference(long):
                word[u] = self.run(u)[1]
                self.chars += len(u)
            if long:
                return sum(long[u] if u in long else word[u] for u in units)
        return sum(map(word.__getitem__, units))

    def trim(self) -> None:
        """Drop what was compiled once it is too much."""
        if len(self.keys) > self.max_states or len(self.word) > self.max_words or self.chars > self.max_chars:
            self._reset()

    def name(self, state: int) -> str:
        """A state as text that any worker can read."""
        return json.dumps(self.keys[state], ensure_ascii=True)

    def state(self, name: str) -> int:
        suffix, places = json.loads(name)
        key = (suffix, tuple(tuple(p) if p else None for p in places))
        if key not in self.ids:
            self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.next.append({})
        return self.ids[key]

    def _breaks(self, text: str) -> tuple[int, int] | None:
        """The places behind which the first and the last break of a text lie, if it has one."""
        found = [m.start() + 1 for m in BREAK.finditer(text)]
        return (found[0], found[-1]) if found else None

    def entry(self, before: str) -> int:
        """The state after the characters before a chunk: certain if they hold a break or are all there is."""
        found = self._breaks(before)
        return self.run(before[found[1] :] if found else before)[0]

    def chunk_map(self, text: str, entries: list[int]) -> list[tuple[int, int]]:
        """Exit state and tokens of a chunk for each entry state."""
        found = self._breaks(text)
        if found is None:
            return [self.run(text, e) for e in entries]
        exit_, tail = self.run(text[found[1] :])
        rest = self.count(text[found[0] : found[1]]) + tail
        return [(exit_, self.run(text[: found[0]], e)[1] + rest) for e in entries]


def transducer(name: str) -> CountTransducer:
    """This worker's transducer for a vocabulary."""
    return one_per_worker(("counts", name), lambda: CountTransducer(tokenizer_path(name)))


def compose(maps: list[dict[str, tuple[str, int]]]) -> dict[str, tuple[str, int]]:
    """The map of chunks in a row: entry to exit and tokens; entries that no map goes on from are left out."""
    out = {e: (e, 0) for e in maps[0]}
    for m in maps:
        out = {e: (m[x][0], n + m[x][1]) for e, (x, n) in out.items() if x in m}
    return out


def token_counts(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", limit: int = 4096, chunk: int = LONGEST, before: int = 256, fan: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document's whole text.

    `chunk` characters are read at once, with `before` characters ahead of them to tell the entry state; `fan`
    maps of neighbours compose in one step."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), (F.char_length("text") <= chunk).alias("short"), "text")

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(tokenizer)
        for b in batches:
            out = []
            for text in b.text:
                t.trim()
                text = text.replace(" ", SPACE)
                out.append(t.count(SPACE + text if text else ""))
            yield b[["doc_id", "n_bytes"]].assign(n_tokens=out)

    counted = rows.where("short").select("doc_id", "n_bytes", "text").mapInPandas(counts, "doc_id string, n_bytes long, n_tokens long")
    long = long_counts(rows.where("not short").select("doc_id", "n_bytes", "text"), tokenizer, chunk, before, fan)
    out = counted if long is None else counted.unionByName(long)
    return out.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("over_limit", F.col("n_tokens") > limit)


def long_counts(texts: DataFrame, tokenizer: str, chunk: int, before: int, fan: int) -> DataFrame | None:
    """doc_id, n_bytes and n_tokens of texts longer than a chunk; None without any."""
    cut = f"explode(transform(sequence(0L, cast(ceil(char_length(text) / {chunk}) as long) - 1), i -> struct(i AS chunk, substring(text, cast(greatest(i * {chunk} - {before}, 0) as int) + 1, cast(i * {chunk} - greatest(i * {chunk} - {before}, 0) as int)) AS ahead, substring(text, cast(i * {chunk} as int) + 1, {chunk}) AS part))) AS c"
    texts = materialize(texts.withColumn("row", F.monotonically_increasing_id()), "long")
    if texts.isEmpty():
        return None
    chunks = materialize(texts.selectExpr("row", cut).select("row", "c.*"), "chunks")

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Maps of chunks for an entry each: the one given, or where none is the one that `ahead` tells."""
        t = transducer(tokenizer)
        for b in batches:
            out = []
            for row, i, ahead, part, name in zip(b.row, b.chunk, b.ahead, b.part, b.entry):
                t.trim()
                ahead, part = ((SPACE if at == 0 else "") + x.replace(" ", SPACE) for x, at in ((ahead, i * chunk - len(ahead)), (part, i)))
                entry = t.state(name) if name else t.entry(ahead) if i else 0
                ((exit_, n),) = t.chunk_map(part, [entry])
                out.append((row, i, t.name(entry), t.name(exit_), n))
            yield pd.DataFrame(out, columns=["row", "chunk", "entry", "exit", "n"])

    schema = "row long, chunk long, entry string, exit string, n long"
    known = materialize(chunks.withColumn("entry", F.lit(None).cast("string")).mapInPandas(maps, schema), "maps")
    fresh = known
    while True:  # ends: a text's chunks have finitely many exits, and each round needs a new one
        asked = fresh.select("row", (F.col("chunk") + 1).alias("chunk"), F.col("exit").alias("entry")).distinct()
        missing = asked.join(known.select("row", "chunk", "entry"), ["row", "chunk", "entry"], "left_anti")
        fresh = materialize(chunks.join(missing, ["row", "chunk"]).mapInPandas(maps, schema), "maps")
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)

    def step(group: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, dict] = {}
        for i, e, x, n in zip(group.chunk, group.entry, group.exit, group.n):
            held.setdefault(i, {})[e] = (x, n)
        one = compose([held[i] for i in sorted(held)])
        return pd.DataFrame([(group.row.iloc[0], group.chunk.iloc[0] // fan, e, x, n) for e, (x, n) in one.items()], columns=["row", "chunk", "entry", "exit", "n"])

    last = known.agg(F.max("chunk")).first()[0]
    while last:
        known = materialize(known.groupBy("row", F.floor(F.col("chunk") / fan).alias("_g")).applyInPandas(step, schema), "maps")
        last //= fan
    start = CountTransducer.START
    total = known.where(F.col("entry") == start).select("row", F.col("n").alias("n_tokens"))
    return texts.select("row", "doc_id", "n_bytes").join(total, "row").select("doc_id", "n_bytes", "n_tokens")
