"""Near-duplicate documents by a chosen-path set-similarity join over minwise tokens.

1. Each text's set of shingles becomes 64-bit hashes, a fingerprint of the whole set and `TOKENS` minwise tokens.
2. Texts with equal sets collapse into one class, represented by the text of the smallest doc_id.
3. Chosen paths: a tree's root holds all classes. A node chooses a few token positions by a hash of its path; each
   class goes to the child named by its token there. Nodes of at most `leaf` classes are compared exhaustively on
   the tokens, larger ones branch on, and at `depth` they are compared inside blocks and with a few of their own
   members (pivots); what is then not connected with the pivot of most members is compared with all of the
   node, cell by cell, so that all pairs of a node meet whatever its size. Independent trees repeat this until a pair at the threshold meets with probability `recall`.
   Comparisons only need to tell which classes may belong together: they leave stars of edges, not all pairs.
4. Connected edges give candidate groups; no pair that met lies across two of them. Inside a group links are
   confirmed on the full sets, by products of incidence matrices. Groups beyond `group` classes are dealt
   in blocks, each with the group's pivots, and what is then outside its group's largest component is held
   against all blocks of the group, by tokens first and by whole sets where those agree, so that no link is lost
   to a size limit.
5. Confirmed links are closed to components by rounds of large-star and small-star joins.

Texts with fewer words than a shingle are one shingle of all their words. Null texts and texts without words have
an empty set and link with nothing, themselves included. Rows with a null id are kept, each unlinked, with a null
component. Rows may share a doc_id: equal texts share a component, different texts have their own ones; each row is
kept as its doc_id is. Very long texts are
read whole. An empty table gives an empty table. Columns other than doc_id and text play no part."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_checked, materialize, one_per_worker, union_all

TOKENS = 64
#: Keys to broadcast at most, some 40 bytes each.
IDS = 500_000
#: Words are cut at the six ASCII white-space characters only.
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


class Shingler:
    """Sets of word-shingle hashes; keeps the hashes of words it has met, up to `limit` and `chars` characters."""

    def __init__(self, words: int, limit: int = 100_000, chars: int = 8_000_000):
        self.words, self.limit, self.chars, self.held = words, limit, chars, 0
        self.known: dict[str, int] = {}

    def set_of(self, text: str) -> np.ndarray:
        """Sorted distinct hashes of the text's shingles."""
        text = text.lower() if text.isascii() else text.translate(_LOWER)
        words = _WORD.findall(text) if _ODD.search(text) else text.split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.limit or self.held > self.chars:
            known.clear()
            self.held = 0
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
            self.held += len(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - self.words + 1)
        out = np.full(n, min(len(h), self.words), np.uint64)
        for k in range(min(self.words, len(h))):
            out = mix(out ^ h[k : k + n]) + np.uint64(0x9E3779B97F4A7C15)
        return np.unique(out)


def shingler(words: int) -> Shingler:
    """This worker's shingler for a width."""
    return one_per_worker(("shingles", words), lambda: Shingler(words))


_SEEDS = mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def minwise(s: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set: per seed the upper half of the smallest mixed hash."""
    low = np.full(TOKENS, np.iinfo(np.uint64).max)
    for at in range(0, len(s), 2048):
        x = s[None, at : at + 2048] ^ _SEEDS[:, None]
        x *= _M1
        x ^= x >> _S
        x *= _M2
        low = np.minimum(low, x.min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32)


def met(similarity: float, depth: int) -> float:
    """The chance that a pair shares a node at `depth`: a node makes one or, by a quarter chance, two choices."""
    p = 1.0
    for _ in range(depth):
        q = similarity * p
        p = 0.75 * q + 0.25 * (1 - (1 - q) ** 2)
    return p


def trees_for(similarity: float, depth: int, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - met(similarity, depth)))


def choices(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per path its first position, its second, and whether it makes the second choice."""
    h = mix(paths)
    first = (h % np.uint64(TOKENS)).astype(int)
    second = (first + 1 + ((h >> np.uint64(8)) % np.uint64(TOKENS - 1)).astype(int)) % TOKENS
    return first, second, ((h >> np.uint64(20)) & np.uint64(3)) == 0


def branch(paths: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of (row's path, row's tokens): the child paths and the rows they come from."""
    first, second, two = choices(paths)
    rows = np.arange(len(paths))
    at = np.concatenate([first, second[two]])
    rows = np.concatenate([rows, rows[two]])
    value = tokens[rows, at].astype(np.uint64)
    return mix(paths[rows] ^ mix(value + (at.astype(np.uint64) << np.uint64(40)))), rows


def forest(n: int, pairs: Iterator[tuple[int, int]] | np.ndarray) -> np.ndarray:
    """Union-find over n members: each member's smallest connected member."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)])


def alike(tokens: np.ndarray, others: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of tokens, row of others) that share at least `least` tokens."""
    hits = [np.empty((0, 2), int)]
    for at in range(0, len(tokens), 64):
        same = (tokens[at : at + 64, None, :] == others[None, :, :]).sum(axis=2)
        found = np.argwhere(same >= least)
        found[:, 0] += at
        hits.append(found)
    out = np.concatenate(hits)
    return out[:, 0], out[:, 1]


def link_matrix(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of a and b are linked: 100 * intersection >= percent * union, on whole sets.

    Intersections are products of incidence matrices over the hashes that more than one set holds, a slice of
    columns at a time."""
    sizes = np.array([len(x) for x in [*a, *b]], np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    _, column, held = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    shared = held[column] > 1
    names, column = np.unique(column[shared], return_inverse=True)
    rows = rows[shared]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    both = np.zeros((len(a), len(b)), np.float64)
    for low in range(0, len(names), 4096):
        lo, hi = np.searchsorted(column, [low, low + 4096])
        m = np.zeros((len(sizes), min(4096, len(names) - low)), np.float32)
        m[rows[lo:hi], column[lo:hi] - low] = 1
        both += m[: len(a)] @ m[len(a) :].T
    whole = sizes[: len(a), None] + sizes[None, len(a) :] - both
    return 100 * both >= percent * whole


# ---------------------------------------------------------------------------------------------- components


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of each vertex, by alternating star joins.

    Each round maps every edge to the smallest neighbour of one of its ends, so paths shorten by half and the sum of
    the ends falls; it ends when a round changes nothing. Rounds are written tables; nothing is gathered on the driver but a count."""
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        # Minima are written first, so that joins with a vertex of very many edges can be split.
        # large star: larger neighbours of a vertex meet its smallest neighbour
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")), "minima")
        large = materialize(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct(), "edges")
        # small star: smaller neighbours of a vertex, and itself, meet the smallest of them
        small = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "minima")
        e = materialize(large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
    roots = e.groupBy("a").agg(F.min("b").alias("root"))
    return vertices.join(roots, vertices["id"] == roots["a"], "left").select("id", F.coalesce("root", "id").alias("component"))


# ---------------------------------------------------------------------------------------------- operator


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, a 128-bit fingerprint of the set, its minwise tokens and one byte of each."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shingler(words)
        for b in batches:
            n, prints, tokens, low = [], [], [], []
            for text in b.text:
                x = s.set_of(text or "")
                n.append(len(x))
                prints.append(xxhash.xxh3_128_digest(x.tobytes()))
                t = minwise(x) if len(x) else np.zeros(0, np.uint32)
                tokens.append(t.tobytes())
                low.append(t.astype(np.uint8).tobytes())
            yield pd.DataFrame({"doc_id": b.doc_id, "text_hash": b.text_hash, "n_shingles": np.array(n, "i8"), "print": prints, "tokens": tokens, "bytes": low})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_hash().alias("text_hash"), "text")
    out = rows.mapInPandas(sketch, "doc_id string, text_hash long, n_shingles long, print binary, tokens binary, bytes binary")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _tokens(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, TOKENS)


def _bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, TOKENS)


def _children(rows: DataFrame) -> DataFrame:
    """path and id of the children of (path, id, tokens)."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                paths, rows = branch(b.path.to_numpy().astype(np.uint64), _tokens(b.tokens))
                yield pd.DataFrame({"path": paths.astype(np.int64), "id": b.id.to_numpy()[rows]})

    return rows.select("path", "id", "tokens").mapInPandas(step, "path long, id long")


def chosen_paths(classes: DataFrame, similarity: float, recall: float, depth: int, leaf: int) -> tuple[DataFrame, DataFrame]:
    """Leaves (path, id) of two to `leaf` classes, and the nodes that are still larger at the last depth, with n."""
    trees = trees_for(similarity, depth, recall)
    rows = classes.select(F.explode(F.array(*[F.xxhash64(F.lit(f"tree {t}")) for t in range(trees)])).alias("path"), "id", "tokens")
    leaves = []
    for level in range(depth):
        nodes = materialize(_children(rows), "nodes")
        sizes = materialize(nodes.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        sized = materialize(nodes.join(sizes, "path"), "sized")
        leaves.append(sized.where(F.col("n") <= leaf).select("path", "id"))
        large = sized.where(F.col("n") > leaf)
        if large.isEmpty():
            break
        rows = large.join(classes.select("id", "tokens"), "id")
    return union_all(leaves), large


def leaf_edges(leaves: DataFrame, least: int) -> DataFrame:
    """Compare all pairs of each leaf on one byte of each token; rows come by path, and a leaf is never split
    between batches. What a task finds is thinned to a forest over the classes."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root: dict[int, int] = {}

        def find(i: int) -> int:
            while (up := root.setdefault(i, i)) != i:
                root[i] = i = root.setdefault(up, up)
            return i

        def stars() -> pd.DataFrame:
            return pd.DataFrame([(i, find(i)) for i in list(root) if find(i) != i], columns=["a", "b"], dtype="int64")

        for b in _whole_runs(batches, "path"):
            path, ids = b.path.to_numpy(), b.id.to_numpy()
            t = _bytes(b.bytes)
            for d in range(1, len(b)):
                i = np.flatnonzero(path[:-d] == path[d:])
                if not len(i):
                    break
                hits = np.concatenate([i[k : k + 65536][(t[i[k : k + 65536]] == t[i[k : k + 65536] + d]).sum(axis=1) >= least] for k in range(0, len(i), 65536)])
                for x, y in zip(ids[hits].tolist(), ids[hits + d].tolist()):
                    u, v = find(x), find(y)
                    if u != v:
                        root[max(u, v)] = min(u, v)
            if len(root) > 1_000_000:
                yield stars()
                root.clear()
        yield stars()

    return leaves.repartition("path").sortWithinPartitions("path", "id").mapInPandas(compare, "a long, b long")


def _whole_runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Batches of sorted rows cut anew so that rows of one key stay together."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        last = b[key].iloc[-1]
        cut = int((b[key].to_numpy() != last).sum())
        if held and held[-1][key].iloc[-1] != b[key].iloc[0]:
            yield pd.concat(held, ignore_index=True)
            held = []
        if cut:
            yield pd.concat([*held, b.iloc[:cut]], ignore_index=True)
            held = []
        held.append(b.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _block_parts(least: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Each class of a block with the smallest one it is connected to, and the smallest pivot, if any."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        g = group.drop_duplicates("id").sort_values("id")
        ids, t = g.id.to_numpy(), _bytes(g.bytes)
        a, b = alike(t, t, least)
        root = forest(len(ids), zip(*(x[a < b].tolist() for x in (a, b))))
        pivot: dict[int, int] = {}
        for i in np.flatnonzero(np.isin(ids, group.id[group.spread])):
            pivot.setdefault(root[i], ids[i])
        return pd.DataFrame(
            {"path": g.path, "n": g.n, "id": ids, "root": ids[root], "pivot": pd.array([pivot.get(r) for r in root], dtype="Int64"), "own": np.isin(ids, group.id[~group.spread]), "bytes": g.bytes}
        )

    return compare


def _cell_edges(least: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """All pairs between two cells of a node, or inside one, as stars."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        g = group.drop_duplicates("id").sort_values(["cell", "id"])
        ids, t, first = g.id.to_numpy(), _bytes(g.bytes), int((g.cell == g.low).sum())
        inside = bool((g.low == g.high).all())
        a, b = alike(t[:first], t if inside else t[first:], least)
        b = b if inside else b + first
        order = np.argsort(ids)
        place = np.empty(len(ids), int)
        place[order] = np.arange(len(ids))
        ids = ids[order]
        root = forest(len(ids), zip(*(place[x[a < b]].tolist() for x in (a, b))))
        apart = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[apart], "b": ids[root[apart]]})

    return compare


def node_edges(large: DataFrame, tokens: DataFrame, least: int, leaf: int, pivots: int, cell: int) -> DataFrame:
    """Edges that connect every pair of a large node (path, id, n) that shares `least` tokens.

    All members lie in blocks, each beside the node's pivots, its members with the smallest hashes. Members that
    are connected with the pivot of most members need no more comparisons among themselves; every other member
    is then compared with all of the node, in tasks of two cells of about `cell` classes."""
    blocks = F.ceil(F.col("n") / leaf)
    seeds = large.groupBy("path").agg(F.first("n").alias("n"), *[F.min_by("id", F.xxhash64(F.lit(k), "id")).alias(f"p{k}") for k in range(pivots)])
    spread = seeds.select("path", "n", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(pivots)]))).alias("id")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    own = large.select("path", "n", "id", F.pmod(F.xxhash64("id"), blocks).alias("block"), F.lit(False).alias("spread"))
    dealt = own.unionByName(spread.withColumn("spread", F.lit(True))).join(tokens, "id")
    held = dealt.groupBy("path", "block").applyInPandas(_block_parts(least), "path long, n long, id long, root long, pivot long, own boolean, bytes binary")
    held = materialize(held, "parts")
    most = held.where("own and pivot is not null").groupBy("path", "pivot").agg(F.count("*").alias("k")).groupBy("path").agg(F.max_by("pivot", F.struct("k", "pivot")).alias("main"), F.max("k").alias("most"))
    split = held.where("own").join(most, "path").where("n > most").withColumn("rest", F.coalesce(F.col("pivot") == F.col("main"), F.lit(False)))
    # cells below `few` hold what lies apart, the others the rest; no task compares two cells of the rest
    few, others = F.ceil((F.col("n") - F.col("most")) / cell), F.ceil(F.col("most") / cell)
    h = F.xxhash64(F.lit("cell"), "id")
    split = split.select("path", "id", "bytes", "rest", few.alias("few"), (few + others).alias("cells"), F.when(F.col("rest"), few + F.pmod(h, others)).otherwise(F.pmod(h, few)).alias("cell"))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("rest"), F.col("few")).otherwise(F.col("cells")) - 1)).alias("other")
    tasks = split.select("path", "id", "bytes", "cell", other).withColumn("low", F.least("cell", "other")).withColumn("high", F.greatest("cell", "other")).drop("other")
    across = tasks.groupBy("path", "low", "high").applyInPandas(_cell_edges(least), "a long, b long")
    return held.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(across)


def candidate_edges(classes: DataFrame, similarity: float, recall: float, depth: int, leaf: int, pivots: int, margin: float) -> DataFrame:
    """Edges whose components hold every pair of classes that met and may be as similar as asked."""
    least = math.floor(TOKENS * max(0.0, similarity - margin))
    leaves, large = chosen_paths(classes, similarity, recall, depth, leaf)
    tokens = classes.select("id", "bytes")
    edges = leaf_edges(leaves.join(tokens, "id"), least)
    return edges if large.isEmpty() else edges.unionByName(node_edges(large, tokens, least, leaf, pivots, 16 * leaf))


def _set_groups(words: int, percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Confirmed links in a group of texts, as stars: each class with the smallest one it is connected to."""

    def confirm(group: pd.DataFrame) -> pd.DataFrame:
        g = group.drop_duplicates("id").sort_values("id")
        ids, s = g.id.to_numpy(), shingler(words)
        sets = [s.set_of(t or "") for t in g.text]
        hits = np.argwhere(np.triu(link_matrix(sets, sets, percent), 1))
        root = forest(len(ids), map(tuple, hits.tolist()))
        apart = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[apart], "b": ids[root[apart]]})

    return confirm


def confirmed_links(groups: DataFrame, texts: DataFrame, tokens: DataFrame, words: int, percent: int, least: int, group: int, pivots: int) -> DataFrame:
    """Links a, b, checked on whole sets, that connect all that is linked inside each candidate group.

    `groups` has id and component for classes in groups of two or more, with the group's size n; `tokens` has id and
    bytes. In groups beyond `group` classes, what lies outside the largest part meets all of the group by its tokens
    first, and only texts with `least` equal ones move."""
    held = groups.join(texts, "id")
    small = held.where(F.col("n") <= group).groupBy("component").applyInPandas(_set_groups(words, percent), "a long, b long")
    many = materialize(groups.where(F.col("n") > group), "many")
    if many.isEmpty():
        return small
    # all members of a large group lie in blocks, each beside the same few members (pivots)
    blocks = F.ceil(F.col("n") / group)
    block = F.pmod(F.xxhash64("id"), blocks)
    chosen = many.groupBy("component").agg(F.first("n").alias("n"), *[F.min_by("id", F.xxhash64(F.lit(k), "id")).alias(f"p{k}") for k in range(pivots)])
    spread = chosen.select("component", "n", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(pivots)]))).alias("id")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = many.select("component", block.alias("block"), "id").unionByName(spread.select("component", "block", "id")).join(texts, "id")
    first = materialize(dealt.groupBy("component", "block").applyInPandas(_set_groups(words, percent), "a long, b long"), "links")
    # what is still outside its group's largest component meets all of the group, in chunks against blocks
    parts = components(many.select("id"), first).withColumnRenamed("component", "part")
    parts = materialize(many.join(parts, "id"), "parts")
    sizes = parts.groupBy("component", "part").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("component").agg(F.max_by("part", F.struct("k", "part")).alias("largest"), F.sum("k").alias("all"), F.max("k").alias("most"))
    apart = largest.where(F.col("all") > F.col("most")).withColumn("chunks", F.ceil((F.col("all") - F.col("most")) / (2 * group)))
    split = materialize(parts.join(apart.select("component", "largest", "chunks"), "component"), "split")
    foreign = split.where("part <> largest").select("component", "id", "part", F.pmod(F.xxhash64(F.lit(1), "id"), F.col("chunks")).alias("chunk"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(True).alias("foreign"))
    whole = split.select("component", "id", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), block.alias("block"), F.lit(False).alias("foreign"))

    def screen(g: pd.DataFrame) -> pd.DataFrame:
        """The members of a chunk and a block that may be linked with one of the other side."""
        f, w = g[g.foreign], g[~g.foreign]
        if not len(f) or not len(w):
            return g[:0].drop(columns="bytes")
        x, y = alike(_bytes(f.bytes), _bytes(w.bytes), least)
        apart = f.part.to_numpy()[x] != w.part.to_numpy()[y]
        return pd.concat([f.iloc[np.unique(x[apart])], w.iloc[np.unique(y[apart])]]).drop(columns="bytes")

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        s = shingler(words)
        f, w = g[g.foreign], g[~g.foreign]
        if not len(f) or not len(w):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        hits = link_matrix([s.set_of(t or "") for t in f.text], [s.set_of(t or "") for t in w.text], percent) & (f.part.to_numpy()[:, None] != w.part.to_numpy()[None, :])
        x, y = np.nonzero(hits)
        pairs = pd.DataFrame({"u": f.part.to_numpy()[x], "v": w.part.to_numpy()[y]}).drop_duplicates()
        return pd.DataFrame({"a": pairs.u, "b": pairs.v})

    cell = ["component", "chunk", "block"]
    met = foreign.unionByName(whole).join(tokens, "id")
    kept = materialize(met.groupBy(*cell).applyInPandas(screen, "component long, id long, part long, chunk long, block long, foreign boolean"), "screened")
    second = kept.join(texts, "id").groupBy(*cell).applyInPandas(compare, "a long, b long")
    return union_all([small, first, second])


def _linked(docs: DataFrame, words: int, percent: int, recall: float, depth: int, leaf: int, group: int, pivots: int, margin: float) -> DataFrame:
    """doc_id, text_hash and n_shingles of each document, and `first`: doc_id and text_hash of its component's first row."""
    sketched = materialize(sketches(docs, words), "sketches")
    one = F.min(F.struct("doc_id", "text_hash")).alias("one")
    grouped = sketched.where("doc_id is not null and n_shingles > 0").groupBy("print", "n_shingles").agg(one, F.first("tokens").alias("tokens"), F.first("bytes").alias("bytes"))
    # a class is named by its set, not by a doc_id, which several sets may share
    classes = materialize(grouped.select(F.xxhash64("print", "n_shingles").alias("id"), "print", "n_shingles", "one.*", "tokens", "bytes"), "classes")
    edges = candidate_edges(classes, percent / 100, recall, depth, leaf, pivots, margin)
    groups = materialize(components(classes.select("id"), edges), "groups")
    sizes = materialize(groups.groupBy("component").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    groups = materialize(groups.join(sizes, "component"), "groups")
    wanted = materialize(classes.join(groups.select("id"), "id").select("id", F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")), "wanted")
    rows = docs.select("doc_id", "text", text_hash().alias("text_hash"))
    met = join_checked(rows, wanted, (F.col("doc_id") == F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), wanted.count(), limit=IDS)
    texts = materialize(met.select("id", "text").dropDuplicates(["id"]), "texts")  # repeated rows bring the same text
    least = math.floor(TOKENS * max(0.0, percent / 100 - margin))
    links = confirmed_links(groups, texts, classes.select("id", "bytes"), words, percent, least, group, pivots)
    parts = classes.select("id", "print", "n_shingles", "doc_id", "text_hash").join(components(classes.select("id"), links), "id")
    smallest = materialize(parts.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")), "smallest")
    named = materialize(parts.join(smallest, "component").select("print", "n_shingles", "first"), "named")
    out = sketched.drop("tokens", "bytes").join(named, ["print", "n_shingles"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", "text_hash", "n_shingles", F.when(linked, F.col("first")).otherwise(F.struct("doc_id", "text_hash")).alias("first"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, recall: float = 0.999, depth: int = 3, leaf: int = 64, group: int = 128, pivots: int = 8, margin: float = 0.22) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document."""
    found = _linked(docs, words, percent, recall, depth, leaf, group, pivots, margin)
    out = found.select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, recall: float = 0.999, depth: int = 3, leaf: int = 64, group: int = 128, pivots: int = 8, margin: float = 0.22) -> DataFrame:
    """The documents without near copies: of each group one row with the smallest doc_id, as it is. Rows of null
    ids and rows without words stay. Of rows that equal in doc_id and text one stays, whatever else they hold."""
    found = materialize(_linked(docs, words, percent, recall, depth, leaf, group, pivots, margin).where("doc_id is not null and n_shingles > 0"), "linked")
    texts = found.groupBy("doc_id", "text_hash", "first").agg(F.count("*").alias("n")).withColumn("stays", F.struct("doc_id", "text_hash") == F.col("first"))
    named = materialize(texts.where("not stays or n > 1").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "stays"), "named")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", text_hash().alias("_h"))
    met = join_checked(rows, named, (F.col("doc_id") == F.col("_doc")) & (F.col("_h") == F.col("_hash")), named.count(), "left", IDS)
    repeated = met.where("stays").dropDuplicates(["doc_id", "_h"])
    return met.where("stays is null").select("_row.*").unionByName(repeated.select("_row.*"))
