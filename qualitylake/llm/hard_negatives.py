"""Hard negatives by anchor spanning-tree bounds.

Anchors are dealt in groups of near ones. Each group gets a minimum spanning tree with the origin, where every score
is 0, as its root. With a score known at a parent, or bounds on it, a child's score lies within the edge's product
with the candidates' centre, plus or minus edge length times the candidate's distance from that centre (its norm, where
the centre is the origin). Candidates stand in blocks of near ones around a pivot, and only those whose bounds meet a
window of scores that the anchor still looks for are scored; each such score bounds the children in its turn.

Two passes send the packed groups to the blocks, once for each part of up to eight blocks, over Spark's shuffle and never
by broadcast. The first finds each anchor's positives: its best rows of the same
label. The second finds, for each positive, the best rows of other labels that score between 80 and 100 percent of it.
A bounded sample of the rows gives each search a score to reach before it starts; it does nothing else.
Scores are whole numbers, exact as in `exact_topk`. Where vectors fill the space evenly, bounds exclude little and most
candidates are scored; the result is exact all the same.

Rows that take part: see vectors.usable; those with a null label take none. Where an id repeats, its smallest vector and
then label stand for it. An anchor without positives, and a positive without rows in its window, gives no rows; with a
positive score below 0 there is no such window. An empty table gives none. Other columns play no part."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize
from .exact_topk import choose_pivots, products
from .vectors import blocks_a_part, dealt, hash_sample, matrix, met, pack_rows, unpack_rows, usable

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_MOST, _LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


@dataclass(frozen=True)
class Tree:
    """Anchors in an order in which parents come first: each one's parent (-1: the origin) and edge."""

    order: np.ndarray
    parent: np.ndarray


def spanning_tree(anchors: np.ndarray) -> Tree:
    """The minimum spanning tree of anchors and the origin, grown from the origin."""
    x = anchors.astype(float)
    near, parent = np.sqrt((x**2).sum(axis=1)), np.full(len(x), -1)
    left, order = np.ones(len(x), bool), []
    while left.any():
        i = int(np.where(left, near, np.inf).argmin())
        left[i] = False
        order.append(i)
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        closer = left & (d < near)
        near[closer], parent[closer] = d[closer], i
    return Tree(np.array(order, int), parent)


@dataclass(frozen=True)
class Block:
    """Candidates: ids, labels, vectors, their centre and distances from it."""

    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    centre: np.ndarray
    far: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> Block:
        x = rows.astype(float)
        # the mean, or the origin where vectors lie nearer to that
        centre = x.mean(axis=0)
        centre = centre if ((x - centre) ** 2).sum() < (x**2).sum() else np.zeros_like(centre)
        return cls(ids, labels, rows, centre, np.sqrt(((x - centre) ** 2).sum(axis=1)))


def windowed(scores: np.ndarray, ids: np.ndarray, low: int, high: int, k: int) -> np.ndarray:
    """Places of the k highest scores from low to high, ties to the smaller id."""
    at = np.flatnonzero((scores >= low) & (scores <= high))
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], -scores[at].astype(float)))][:k] if np.abs(scores[at]).max(initial=0) < 2**53 else np.array(sorted(at.tolist(), key=lambda j: (-int(scores[j]), ids[j])), int)[:k]


def search(block: Block, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, tree: Tree, windows: list[list[tuple[int, int]]], same: bool, k: int) -> tuple[list[tuple[int, int, np.ndarray, np.ndarray]], int]:
    """For each anchor and window of scores the places of the k best rows in it, of the anchor's label or of others;
    and how many rows were scored."""
    found, scored, x = [], 0, anchors.astype(float)
    lows, highs = np.zeros((len(ids), len(block.ids))), np.zeros((len(ids), len(block.ids)))
    to_centre = x @ block.centre
    norms = np.sqrt((block.rows.astype(float) ** 2).sum(axis=1))
    for a in tree.order.tolist():
        p = tree.parent[a]
        edge, moved = (x[a], to_centre[a]) if p < 0 else (x[a] - x[p], to_centre[a] - to_centre[p])
        reach = np.sqrt(edge @ edge) * block.far
        low, high = (moved - reach, moved + reach) if p < 0 else (lows[p] + moved - reach, highs[p] + moved + reach)
        slack = 1e-6 * (1 + np.abs(moved) + reach + np.sqrt(x[a] @ x[a]) * norms)
        # scores end at the range of a long, and so do their bounds
        lows[a], highs[a] = np.minimum(low - slack, 2.0**63), np.maximum(high + slack, -(2.0**63))
        fits = (block.labels == labels[a]) == same
        fits &= block.ids != ids[a]
        asked = np.zeros(len(fits), bool)
        for least, most in windows[a]:
            asked |= (highs[a] >= least) & (lows[a] <= most)
        at = np.flatnonzero(fits & asked)
        if not len(at):
            continue
        exact = products(anchors[a : a + 1], block.rows[at])[0]
        lows[a, at] = highs[a, at] = exact
        scored += len(at)
        for n, (least, most) in enumerate(windows[a]):
            best = windowed(exact, block.ids[at], least, most, k)
            if len(best):
                found.append((a, n, at[best], exact[best]))
    return found, scored


def floors(scores: np.ndarray, high: int, low: int, k: int) -> int:
    """A score that the k best from low to high reach at least, given the scores of some rows."""
    s = scores[(scores >= low) & (scores <= high)]
    return int(np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else low


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, k: int = 5, negatives: int = 5, scale: float = 256.0, sample: int = 2048, block: int = 2048, group: int = 128) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores: for each anchor and each of its `k` best rows of
    the same label the `negatives` best rows of other labels that score 80 to 100 percent of it.

    Scores are inner products of floor(scale * component); `label` replaces the column of that name."""
    spark = vectors.sparkSession
    labelled = vectors.select("vec_id", "embedding", (F.col("label") if label is None else label).cast("long").alias("label")).where("label is not null")
    rows, dim = usable(labelled, beside="label")
    if not dim:
        return spark.createDataFrame([], RESULT)

    def quantized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"vec_id": b.vec_id, "label": b.label, "v": pack_rows(np.floor(scale * matrix(b.embedding, dim)))})

    whole = materialize(rows.mapInPandas(quantized, "vec_id long, label long, v binary"), "vectors")
    n_rows = whole.count()
    seen = hash_sample(whole, n_rows, sample)  # `sample` rows at most
    seen_ids, seen_labels = np.array([r["vec_id"] for r in seen]), np.array([r["label"] for r in seen])
    seen_rows = unpack_rows([bytes(r["v"]) for r in seen], dim)
    pivots = choose_pivots(seen_rows.astype(float), max(1, min(int(n_rows**0.5) // 16, sample // 4)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = unpack_rows(b.v.tolist(), dim).astype(float)
            # nearest by |x|^2 - 2 x.p + |p|^2; any cell is right, nearer ones only bound better
            d = (pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T
            yield b.assign(cell=d.argmin(axis=1).astype("i4"))

    placed = materialize(whole.mapInPandas(assign, "vec_id long, label long, v binary, cell int"), "cells")
    counts = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row per pivot
    n_blocks = [-(-counts.get(c, 0) // block) for c in range(len(pivots))]
    a_part = blocks_a_part(sum(n_blocks))

    def per_cell(numbers: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(n) for n in numbers]), F.col("cell") + 1)

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("vec_id")
        return pd.DataFrame({"part": g.block.iloc[:1] // a_part, "ids": [g.vec_id.to_numpy().astype("<i8").tobytes()], "labels": [g.label.to_numpy().astype("<i8").tobytes()], "rows": [unpack_rows(g.v.tolist(), dim).astype("<i8").tobytes() if g.v.str.len().max() > 2 * dim else b"".join(g.v)]})

    within = F.pmod(F.xxhash64("vec_id"), per_cell([max(1, n) for n in n_blocks])).cast("int")
    numbered = placed.withColumn("block", per_cell([sum(n_blocks[:c]) for c in range(len(n_blocks))]) + within)
    blocks = numbered.groupBy("block").applyInPandas(pack, "part int, ids binary, labels binary, rows binary")

    def read(data: bytes, n: int) -> np.ndarray:
        return np.frombuffer(data, "<i2" if len(data) == 2 * dim * n else "<i8").reshape(n, dim).astype(np.int64)

    def searched(anchors: DataFrame, same: bool, most: int) -> DataFrame:
        """anchor_id, positive_id (null for a search of positives), vec_id and score, each block's best. `anchors` has vec_id, label, v, cell
        and, for each window, positive_id, low and high."""

        def send(g: pd.DataFrame) -> pd.DataFrame:
            """A group, with its tree and what it looks for."""
            once = g.drop_duplicates("vec_id")
            ids, labels, x = once.vec_id.to_numpy(), once.label.to_numpy(), unpack_rows(once.v.tolist(), dim)
            own = products(x, seen_rows)
            fine = ((seen_labels[None, :] == labels[:, None]) == same) & (seen_ids[None, :] != ids[:, None])
            at = {v: i for i, v in enumerate(ids.tolist())}
            which = np.array([at[v] for v in g.vec_id.tolist()])
            low = [floors(own[i][fine[i]], b, a, most) for i, a, b in zip(which, g.low.tolist(), g.high.tolist())]
            tree = spanning_tree(x)
            wide = np.abs(x).max(initial=0) >= 1 << 15
            sent = {"ids": ids, "labels": labels, "order": tree.order, "parent": tree.parent, "which": which, "positive": g.positive_id.to_numpy(), "low": np.array(low, np.int64), "high": g.high.to_numpy()}
            return pd.DataFrame({**{f"a_{c}": [v.astype("<i8").tobytes()] for c, v in sent.items()}, "a_rows": [x.astype("<i8" if wide else "<i2").tobytes()]})

        n = anchors.select("cell", "vec_id").distinct().groupBy("cell").agg(F.ceil(F.count("*") / group).alias("groups")).select(F.col("cell").alias("c"), "groups")
        grouped = anchors.join(F.broadcast(n), F.col("cell") == F.col("c")).withColumn("group", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("groups")))  # a row per pivot
        names = ("ids", "labels", "order", "parent", "which", "positive", "low", "high", "rows")
        packed = dealt(grouped, ["cell", "group"]).groupBy("cell", "group").applyInPandas(send, ", ".join(f"a_{c} binary" for c in names))
        sent = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((sum(n_blocks) - 1) // a_part))))  # every block

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for ids, labels, data, *of_group in zip(b.ids, b.labels, b["rows"], *[b[f"a_{c}"] for c in names]):
                    ids = np.frombuffer(ids, "<i8")
                    held = Block.of(ids, np.frombuffer(labels, "<i8"), read(data, len(ids)))
                    a_ids, a_labels, order, parent, which, positive, low, high = [np.frombuffer(x, "<i8") for x in of_group[:-1]]
                    mine: list[list[int]] = [[] for _ in a_ids]
                    for w, i in enumerate(which.tolist()):
                        mine[i].append(w)
                    windows = [[(int(low[w]), int(high[w])) for w in some] for some in mine]
                    found, _ = search(held, a_ids, a_labels, read(of_group[-1], len(a_ids)), Tree(order, parent), windows, same, most)
                    if found:
                        n = [len(at) for *_, at, _ in found]
                        yield pd.DataFrame({"anchor_id": np.repeat([a_ids[a] for a, *_ in found], n), "positive_id": np.repeat([positive[mine[a][w]] for a, w, *_ in found], n), "vec_id": held.ids[np.concatenate([f[2] for f in found])], "score": np.concatenate([f[3] for f in found])})

        return met(sent, blocks, ["part"]).mapInPandas(solve, "anchor_id long, positive_id long, vec_id long, score long")

    asked = placed.where(is_anchor)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    found = searched(asked.select("*", F.lit(0).cast("long").alias("positive_id"), F.lit(_LEAST).alias("low"), F.lit(_MOST).alias("high")), True, k)
    positives = materialize(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # the least whole number n with 100 n >= 80 score
    low = F.col("positive_score") - F.expr("(positive_score - pmod(positive_score, 5L)) div 5L")
    wanted = asked.join(positives.where("positive_score >= 0"), F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "v", "cell", "positive_id", low.alias("low"), F.col("positive_score").alias("high"))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    ranked = searched(wanted, False, negatives).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.join(positives, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
