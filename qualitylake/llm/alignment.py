"""Cross-tokenizer alignment by inverted pair bitmaps.

Two tokenizers cut each text, and the byte offsets where tokens of both end together cut it into groups; the two tokens
that end a group are linked. Documents are numbered within shards, and each pair of linked ids has a posting a shard:
compressed bitmaps of documents, one per bit of how often the document holds the pair. The union of the planes counts
documents, the planes weighted by 2^k count links; sums over shards give the corpus' counts. Then each posting takes its
pair's count back to the documents it lists, a shard at a time, so no document ever meets pairs one by one.

A text is cut where white space follows anything else: neither vocabulary has tokens that go on there, so tokens and
groups of the parts in a row are the text's. Workers keep the parts that they have met, up to a bound.

A text that is null or empty, or that one of the tokenizers does not give back byte by byte, has no tokens: its numbers
are 0 and its hash is ''. Rows are kept one by one whatever repeats, null ids too; very long texts count whole.
An empty table gives an empty one. Columns other than doc_id and text play no part."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, one_per_worker, runs, tokenizer_path
from .encoding import _byte_letters

#: Bits for an id of either vocabulary and for a document's number in its shard.
_ID, _DOC = 24, 16
_PART = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space besides spaces and new lines, by any of the libraries; texts with some are cut by the slower rule.
_OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85᠎​﻿]")
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85᠎​﻿])(?=[ \n])")


def parts_of(text: str) -> list[str]:
    return _CUT.split(text) if _OTHER_SPACE.search(text) else _PART.findall(text)


class Aligner:
    """Tokens and groups of texts by two vocabularies; keeps up to `limit` parts and `chars` characters of them."""

    def __init__(self, a_path: str, b_path: str, limit: int = 300_000, chars: int = 12_000_000):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.space = [self.b.piece_to_id("▁")]
        to_byte = {c: b for b, c in _byte_letters().items()}
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") or "\n" in p for i, p in enumerate(pieces) if not self.b.is_byte(i)):
            raise ValueError("pieces of this vocabulary go on after white space")
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.shown = np.array([f"{i}{c}" for i in range(len(self.a_bytes)) for c in ",|"] + [f"{i}{c}" for i in range(len(self.b_bytes)) for c in ",;\0"], dtype=object)
        self.limit, self.chars, self.held = limit, chars, 0
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.text: list[str] = []
        self.counts = np.zeros((1024, 4), np.int64)
        self.links = np.zeros(4096, np.int64)
        self.held = 0

    def ids(self, part: str) -> tuple[list[int], list[int]]:
        """Both tokenizers' ids of one part that starts with a space or a new line."""
        return self._encode([part])[0]

    def _encode(self, new: list[str]) -> list[tuple[list[int], list[int]]]:
        """A space opens every B text that is not empty by itself; before a new line it is one token more, which goes."""
        by_a = self.a.encode_batch_fast(new, add_special_tokens=False)
        by_b = self.b.encode([p[1:] if p[0] == " " else p for p in new], num_threads=1)
        return [(a.ids, self.space if p == " " else b if p[0] == " " else b[1:]) for p, a, b in zip(new, by_a, by_b)]

    def _valid(self, new: list[str], ids: list[tuple[list[int], list[int]]]) -> np.ndarray:
        """Whether both tokenizers give each part back byte by byte."""
        return np.array([b"".join([self.a_bytes[i] for i in a]) == part.encode() == b"".join([self.b_bytes[i] for i in b]) for part, (a, b) in zip(new, ids)], bool)

    def _learn(self, new: list[str]) -> None:
        ids = self._encode(new)
        valid = self._valid(new, ids)
        fine = [x for x, ok in zip(ids, valid) if ok]
        n_a, n_b = (np.array([len(x[k]) for x in fine], np.int64) for k in (0, 1))
        a, b = (np.fromiter((i for x in fine for i in x[k]), np.int64, int(n.sum())) for k, n in ((0, n_a), (1, n_b)))
        # ends of tokens in all parts in a row; parts end together, so groups never cross from one to the next
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        of_b = np.searchsorted(b_ends, a_ends)
        a_shared = b_ends[of_b] == a_ends
        b_shared = np.zeros(len(b), bool)
        b_shared[of_b[a_shared]] = True
        links = a[a_shared] << _ID | b[b_shared]
        a_group, b_group = np.cumsum(a_shared) - a_shared, np.cumsum(b_shared) - b_shared
        # each id with what follows it in the text of groups: , or | after ids of a, and , or ; or the part's end after ids of b
        after = b_shared.astype(int)
        after[np.cumsum(n_b) - 1] = 2
        keys = np.concatenate([a * 2 + a_shared, 2 * len(self.a_bytes) + b * 3 + after])
        order = np.argsort(np.concatenate([a_group * 2, b_group * 2 + 1]), kind="stable")
        texts = iter("".join(self.shown[keys[order]].tolist()).split("\0"))
        groups = np.diff(np.searchsorted(np.flatnonzero(a_shared), np.concatenate([[0], np.cumsum(n_a)])))
        rows = np.zeros((len(new), 4), np.int64)
        rows[~valid, 0] = -1
        rows[valid, :3] = np.stack([n_a, n_b, groups], axis=1)
        at = int(self.counts[len(self.text) - 1, 3]) if self.text else 0
        rows[:, 3] = at + np.cumsum(rows[:, 2])
        self.text += [next(texts) if ok else "" for ok in valid.tolist()]
        n, at = len(self.text), at + len(links)
        while len(self.counts) < n:
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.counts[n - len(new) : n] = rows
        while len(self.links) < at:
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.links[at - len(links) : at] = links
        self.held += sum(map(len, new))
        self.known.update(zip(new, range(n - len(new), n)))

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Per text n_a, n_b, n_groups and the hash of its groups; and the links of all texts in a row, as text and pair."""
        if len(self.known) > self.limit or self.held > self.chars:
            self._forget()
        parts = [parts_of(" " + t) if t else [] for t in texts]
        new = list(set().union(*parts).difference(self.known))
        if new:
            self._learn(new)
        get, counts, digests, kept, of = self.known.__getitem__, np.zeros((len(texts), 3), np.int64), [], [], []
        for n, some in enumerate(parts):
            at = list(map(get, some))
            rows = self.counts[at]
            if not at or (rows[:, 0] < 0).any():
                digests.append("")
                continue
            counts[n] = rows[:, :3].sum(axis=0)
            digests.append(hashlib.sha256(";".join(map(self.text.__getitem__, at)).encode()).hexdigest())
            kept.append(rows[:, 2:])
            of.append(np.full(len(rows), n))
        if not kept:
            return counts, digests, np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes, of = np.concatenate(kept), np.concatenate(of)
        n = sizes[:, 0]
        first = np.repeat(sizes[:, 1] - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return counts, digests, np.repeat(of, n), self.links[first]


def container(docs: np.ndarray) -> bytes:
    """Sorted document numbers below 65,536: as they are, or as a bitmap where that is shorter."""
    if len(docs) <= 1 << (_DOC - 4):
        return struct.pack("<BH", 0, len(docs)) + docs.astype("<u2").tobytes()
    bits = np.zeros(1 << _DOC, bool)
    bits[docs] = True
    return struct.pack("<BH", 1, 0) + np.packbits(bits, bitorder="little").tobytes()


def planes_of(data: bytes) -> list[np.ndarray]:
    """The document numbers of each plane of a posting, sorted."""
    out, at = [], 0
    while at < len(data):
        kind, n = struct.unpack_from("<BH", data, at)
        size = 1 << (_DOC - 3) if kind else 2 * n
        body = np.frombuffer(data, np.uint8, size, at + 3)
        out.append(np.flatnonzero(np.unpackbits(body, bitorder="little")) if kind else body.view("<u2"))
        at += 3 + size
    return out


def merged(postings: list[bytes]) -> int:
    """How many documents the union of the planes of some postings of one shard holds."""
    bits = np.zeros(1 << _DOC, bool)
    for data in postings:
        for plane in planes_of(data):
            bits[plane] = True
    return int(bits.sum())


def postings_of(entries: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, int, int, int, bytes]]:
    """a, b, documents, links and planes of each pair, from sorted entries (a, b and document in one number) and how
    often each document holds the pair."""
    pair, docs = entries >> np.int64(_DOC), (entries & np.int64((1 << _DOC) - 1)).astype("<u2")
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, int)
    last = np.append(first[1:], len(pair))
    most, links = (np.maximum.reduceat(times, first), np.add.reduceat(times, first)) if len(first) else (times, times)
    for p, i, j, top, n in zip(pair[first].tolist(), first.tolist(), last.tolist(), most.tolist(), links.tolist()):
        if top == 1:
            data = container(docs[i:j])
        else:
            some = times[i:j]
            data = b"".join(container(docs[i:j][(some >> k & 1) == 1]) for k in range(top.bit_length()))
        yield p >> _ID, p & ((1 << _ID) - 1), j - i, n, data


_DOCS = "shard long, doc int, none boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_INDEX = _DOCS + ", a int, b int, docs long, links long, planes binary"


_COLUMNS = [c.split()[0] for c in _INDEX.split(", ")]


def _filled(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of documents or of postings with nulls in the other kind's columns."""
    nothing = pd.Series([None] * len(rows), index=rows.index, dtype=object)
    return rows.assign(**{c: nothing for c in _COLUMNS if c not in rows})[_COLUMNS]


def pair_index(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", entries: int = 4_000_000) -> DataFrame:
    """Written once: documents by shard and number, and the postings of each shard. A shard ends at 65,536 documents or
    about `entries` of their pairs."""
    a_path, b_path = tokenizer_path(a), tokenizer_path(b)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = one_per_worker(("align", a_path, b_path), lambda: Aligner(a_path, b_path))
        held, n, size, shard = [], 0, 0, None

        def flushed() -> pd.DataFrame:
            keys, times = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(keys)
            rows = list(postings_of(keys[order], times[order]))
            return pd.DataFrame(dict(zip(_COLUMNS[-5:], zip(*rows))) if rows else {c: [] for c in _COLUMNS[-5:]}).astype({"planes": object}).assign(shard=shard)

        for batch in batches:
            texts = batch.text.tolist()
            shard = int(batch.part.iloc[0]) << 32 if shard is None and len(batch) else shard
            for i, j in runs(texts):
                if held and (n + j - i > 1 << _DOC or size >= entries):
                    yield _filled(flushed())
                    held, n, size, shard = [], 0, 0, shard + 1
                counts, digests, of, pair = aligner.align(texts[i:j])
                keys, times = np.unique(pair << np.int64(_DOC) | (of + n), return_counts=True)
                held.append((keys, times))
                part = batch.iloc[i:j]
                rows = pd.DataFrame({"shard": shard, "doc": np.arange(n, n + j - i), "none": part.none.to_numpy(), "doc_id": part.id.to_numpy(), "n_a": counts[:, 0], "n_b": counts[:, 1], "n_groups": counts[:, 2], "n_links": counts[:, 2], "groups_sha256": pd.Series(digests, dtype=object)})
                yield _filled(rows)
                n, size = n + j - i, size + len(keys)
        if held:
            yield _filled(flushed())

    rows = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return materialize(rows.mapInPandas(index, _INDEX), "pairs")




def pair_counts(index: DataFrame) -> DataFrame:
    """a, b, n_docs, n_links of every linked pair, and whether no pair of its b has more links."""
    counts = index.where("planes is not null").groupBy("a", "b").agg(F.sum("docs").alias("n_docs"), F.sum("links").alias("n_links"))
    return counts.withColumn("best", F.col("n_links") == F.max("n_links").over(Window.partitionBy("b")))


def alignment_report(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row."""
    index = pair_index(docs, a, b)
    counts = pair_counts(index).select("a", "b", F.col("n_links").alias("count"), "best")
    scored = index.where("planes is not null").select("shard", "a", "b", "planes").join(counts, ["a", "b"]).select(F.col("shard").alias("of_shard"), "planes", "count", "best")
    names = [c for c in _COLUMNS[:9] if c not in ("shard", "doc")]

    def gather(rows: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        """A shard's documents with what its postings return to them."""
        best, total = np.zeros(1 << _DOC, np.int64), np.zeros(1 << _DOC, np.int64)
        for data, count, top in zip(postings.planes, postings["count"].tolist(), postings.best.tolist()):
            for k, plane in enumerate(planes_of(data)):
                total[plane] += count << k
                if top:
                    best[plane] += 1 << k
        at = rows.doc.to_numpy().astype(int)
        return rows[names].assign(n_best=best[at], count_sum=total[at])

    by_shard = index.where("doc is not null").select("shard", "doc", *names).groupBy("shard")
    out = by_shard.cogroup(scored.groupBy("of_shard")).applyInPandas(gather, _DOCS.replace("shard long, doc int, ", "") + ", n_best long, count_sum long")
    return out.select(F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
