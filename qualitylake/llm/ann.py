"""Approximate nearest neighbours by inner product: stable projections, kd-trees and a chi-square stop.

Vectors get one more component that makes all norms equal, so the largest inner product is the smallest distance.
A Gaussian matrix projects them to `m` dimensions: the squared projected distance over the squared distance is
chi-square with m degrees of freedom. A kd-tree over a bounded sample's projected points cuts the space into cells;
rows lie in blocks of their cell, each block with a kd-tree of its own. A query first searches a block of its own
cell, then the blocks of all cells that its test can't exclude. In a block it takes the leaves from near to far,
verifies the points that the test can't exclude by their true inner products, and stops when the next leaf is so
far in the projection that, for a point better than the k-th best so far, so large a ratio has a chance below
1 - `confidence`. A sample of at most a quarter of the rows gives the score that the test starts with, and no results:
all that is returned was found by the index, by either of a query's two searches.

Every row is indexed. Vectors that take no part: see vectors.usable, and zero vectors. Ties go to the smaller
vec_id. Scores are sums over the original components in order, the same wherever a pair is met; components so large
that products leave the range of doubles are scaled for the search, and their scores are as doubles give them. A
table with fewer than k candidates gives what is found of them; an empty one gives no rows. Columns other than
vec_id and embedding play no part."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import matrix, ranked, usable

RESULT = "query_id long, rank int, vec_id long, score double"


def chi_square_cdf(x: float, m: int) -> float:
    """Of an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, m: int) -> float:
    low, high = 0.0, 20.0 * m + 100
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, m) < p else (low, mid)
    return high


class KdTree:
    """Median splits along the widest axis down to `leaf` points; `order` lists the points leaf by leaf."""

    def __init__(self, points: np.ndarray, leaf: int = 16):
        runs, stack = [], [np.arange(len(points))]
        while stack:
            at = stack.pop()
            if len(at) <= leaf:
                runs.append(at)
                continue
            axis = int(np.ptp(points[at], axis=0).argmax())
            half = len(at) // 2
            cut = np.argpartition(points[at, axis], half)
            stack += [at[cut[:half]], at[cut[half:]]]
        self.order = np.concatenate(runs)
        self.starts = np.cumsum([0, *map(len, runs)])
        self.low = np.array([points[r].min(axis=0) for r in runs])
        self.high = np.array([points[r].max(axis=0) for r in runs])
        self.points = points[self.order]
        self.squares = (self.points * self.points).sum(axis=1)


def box_distances(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from each point to each box."""
    out = np.zeros((len(q), len(low)))
    for j in range(q.shape[1]):
        gap = np.maximum(0, np.maximum(low[None, :, j] - q[:, None, j], q[:, None, j] - high[None, :, j]))
        out += gap * gap
    return out


class Cells:
    """The top of a kd-tree over a sample: `depth` median cuts, as arrays, so that any point finds its cell."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, n = depth, (1 << depth) - 1
        self.axis, self.cut = np.zeros(n, int), np.zeros(n)
        held = {0: points}
        for node in range(n):
            p = held.pop(node)
            if len(p):
                self.axis[node] = int(np.ptp(p, axis=0).argmax())
                self.cut[node] = np.median(p[:, self.axis[node]])
            above = p[:, self.axis[node]] > self.cut[node]
            if 2 * node + 1 < n:
                held[2 * node + 1], held[2 * node + 2] = p[~above], p[above]

    def of(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), int)
        for _ in range(self.depth):
            at = 2 * at + 1 + (points[np.arange(len(points)), self.axis[at]] > self.cut[at])
        return at - ((1 << self.depth) - 1)


def pair_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, each summed in one order whatever stands beside it."""
    with np.errstate(over="ignore", invalid="ignore"):
        return (q * x).sum(axis=1)


def search(tree: KdTree, x: np.ndarray, ids: np.ndarray, lift: np.ndarray, q: np.ndarray, q_ids: np.ndarray, q_low: np.ndarray, kth: np.ndarray, k: int, stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """What a group of queries finds in a block: query places, places, the queries' k-th best scores then, and the
    share of (query, leaf) that was visited.

    x and ids are in the tree's order. lift: the common squared norm plus the query's, so that lift - 2 * score
    is a squared distance. A query takes its leaves from near to far in rounds of growing size; before each leaf
    its test is made anew, so leaves beyond its stop are never opened."""
    boxes = box_distances(q_low, tree.low, tree.high)
    rank = np.argsort(np.argsort(boxes, axis=1, kind="stable"), axis=1)
    kth, top = kth.copy(), np.full((len(q), k), -np.inf)
    squares = (q_low * q_low).sum(axis=1)
    found, visited, first, n = [], 0, 0, boxes.shape[1]
    while first < n:
        last = min(n, 2 * first + 1)
        due = (rank >= first) & (rank < last) & (boxes < (stop * np.maximum(0, lift - 2 * kth))[:, None])
        if not due.any():  # all later leaves are farther
            break
        for leaf in np.flatnonzero(due.any(axis=0)):
            rows, part = np.flatnonzero(due[:, leaf]), slice(tree.starts[leaf], tree.starts[leaf + 1])
            reach = stop * np.maximum(0, lift[rows] - 2 * kth[rows])
            near = boxes[rows, leaf] < reach
            rows, reach = rows[near], reach[near]
            visited += len(rows)
            gaps = squares[rows, None] - 2 * (q_low[rows] @ tree.points[part].T) + tree.squares[None, part]
            fits = (gaps < reach[:, None]) & (ids[None, part] != q_ids[rows, None])
            scores = np.where(fits, q[rows] @ x[part].T, -np.inf)
            # a little below the k-th best: what is kept is scored anew
            i, j = np.nonzero(scores >= (kth[rows] - 1e-9 * lift[rows])[:, None])
            i, j = i[scores[i, j] > -np.inf], j[scores[i, j] > -np.inf]
            if len(i):
                found.append((rows[i], part.start + j, scores[i, j]))
                some = np.unique(i)
                top[rows[some]] = np.partition(np.concatenate([top[rows[some]], scores[some]], axis=1), -k, axis=1)[:, -k:]
                kth[rows[some]] = np.maximum(kth[rows[some]], top[rows[some]].min(axis=1))
        first = last
    if not found:
        return np.zeros(0, int), np.zeros(0, int), kth, visited / max(1, boxes.size)
    at, places, scores = (np.concatenate(c) for c in zip(*found))
    keep = scores >= kth[at] - 1e-9 * lift[at]
    return at[keep], places[keep], kth, visited / max(1, boxes.size)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, m: int = 6, confidence: float = 0.93, sample: int = 8192, block: int = 8192, queries: int = 1024, leaf: int = 64, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id and score: of each query the k nearest found among all rows but its own."""
    spark = vectors.sparkSession
    rows, dim = usable(vectors, zero=False)
    if not dim:
        return spark.createDataFrame([], RESULT)
    rows = materialize(rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "vectors")
    largest = rows.agg(F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x))))).first()[0]
    unit = 2.0 ** -max(-1000, min(1000, math.frexp(largest)[1]))  # searches see components of at most 1
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x * unit) * (x * unit))
    n, longest = rows.agg(F.count("*"), F.max(norm)).first()
    seen = rows.orderBy(F.xxhash64("vec_id")).limit(max(1, min(sample, n // 4))).collect()  # `sample` rows at most
    seen_ids, seen_x = np.array([r["vec_id"] for r in seen]), np.array([r["embedding"] for r in seen], float)
    onto = np.random.default_rng(seed).standard_normal((dim + 1, m))
    stop = chi_square_quantile(confidence, m)

    def lifted(x: np.ndarray) -> np.ndarray:
        """The projections of data rows, their added component included; queries have none."""
        x = x * unit
        return x @ onto[:-1] + np.sqrt(np.maximum(0.0, longest - (x * x).sum(axis=1)))[:, None] * onto[-1]

    cells = Cells(lifted(seen_x), max(0, min(9, math.ceil(math.log2(n / block)))))
    share = spark.sparkContext.broadcast(seen_x * unit)  # `sample` rows

    def with_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            low = lifted(matrix(b.embedding, dim))
            yield b.assign(cell=cells.of(low).astype("i4"), low=list(low))

    placed = materialize(rows.withColumn("asked", F.coalesce(is_query, F.lit(False))).mapInPandas(with_cell, "vec_id long, embedding array<double>, asked boolean, cell int, low array<double>"), "cells")
    box = [f(F.col("low")[j]).alias(f"{side}{j}") for side, f in (("low", F.min), ("high", F.max)) for j in range(m)]
    summary = placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("asked").alias("q"), *box).collect()  # a row per cell, 512 at most
    names = np.array([r["cell"] for r in summary])
    low, high = (np.array([[r[f"{side}{j}"] for j in range(m)] for r in summary]) for side in ("low", "high"))
    blocks_of = {r["cell"]: -(-r["n"] // block) for r in summary}
    groups_of = {r["cell"]: max(1, -(-r["q"] // queries)) for r in summary}

    def per_cell(counts: dict[int, int]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in counts.items() for x in pair]), F.col("cell"))

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("vec_id")
        return pd.DataFrame({"cell": g.cell.iloc[:1], "block": g.block.iloc[:1], "ids": [g.vec_id.to_numpy().astype("<i8").tobytes()], "rows": [matrix(g.embedding, dim).tobytes()]})

    dealt = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), per_cell(blocks_of)).cast("int"))
    blocks = materialize(dealt.groupBy("cell", "block").applyInPandas(pack, "cell int, block int, ids binary, rows binary"), "blocks")

    def group(g: pd.DataFrame) -> pd.DataFrame:
        """A group of queries of one cell with their k-th best scores in the sample, for the first block of the cell."""
        ids, q = g.vec_id.to_numpy(), matrix(g.embedding, dim)
        scores = (q * unit) @ share.value.T
        scores[ids[:, None] == seen_ids[None, :]] = -np.inf
        kth = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(q), -np.inf)
        return pd.DataFrame({"cell": g.cell.iloc[:1], "block": np.zeros(1, "i4"), "q_ids": [ids.astype("<i8").tobytes()], "q_rows": [q.tobytes()], "kth": [kth.tobytes()]})

    asked = dealt.where("asked").withColumn("group", F.pmod(F.xxhash64(F.lit(1), "vec_id"), per_cell(groups_of)))
    grouped = asked.groupBy("cell", "group").applyInPandas(group, "cell int, block int, q_ids binary, q_rows binary, kth binary")

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """Each group that meets a block: the row, ids, queries and what search returns."""
        held: tuple = ("", None)
        for b in batches:
            for r in b.itertuples(index=False):
                if held[0] != (r.cell, r.block):
                    x, ids = np.frombuffer(r.rows).reshape(-1, dim), np.frombuffer(r.ids, "<i8")
                    tree = KdTree(lifted(x), leaf)
                    held = ((r.cell, r.block), (x[tree.order], ids[tree.order], tree))
                x, ids, tree = held[1]
                q_ids, q = np.frombuffer(r.q_ids, "<i8"), np.frombuffer(r.q_rows).reshape(-1, dim)
                u = q * unit
                yield r, q_ids, q, ids, x, search(tree, x * unit, ids, longest + (u * u).sum(axis=1), u, q_ids, u @ onto[:-1], np.frombuffer(r.kth), k, stop)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups with the k-th best scores that a block of their cell gives, and what was found there."""
        for r, q_ids, q, ids, x, (at, places, kth, _) in searched(batches):
            hits = (q_ids[at].astype("<i8"), ids[places].astype("<i8"), pair_scores(q[at], x[places]).astype("<f8"))
            yield pd.DataFrame({"q_ids": [r.q_ids], "q_rows": [r.q_rows], "kth": [kth.tobytes()], **{c: [v.tobytes()] for c, v in zip(("query_id", "vec_id", "score"), hits)}})

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What the first blocks gave: the test with a higher score to reach may pass over some of it."""
        for b in batches:
            for r in b.itertuples(index=False):
                yield pd.DataFrame({"query_id": np.frombuffer(r.query_id, "<i8"), "vec_id": np.frombuffer(r.vec_id, "<i8"), "score": np.frombuffer(r.score, "<f8")})

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries for the blocks of each cell that their test can't exclude."""
        for b in batches:
            for r in b.itertuples(index=False):
                q_ids, q, kth = np.frombuffer(r.q_ids, "<i8"), np.frombuffer(r.q_rows).reshape(-1, dim), np.frombuffer(r.kth)
                u = q * unit
                near = box_distances(u @ onto[:-1], low, high) < (stop * np.maximum(0, longest + (u * u).sum(axis=1) - 2 * kth))[:, None]
                for c in np.flatnonzero(near.any(axis=0)):
                    to, at = np.arange(blocks_of[names[c]], dtype="i4"), near[:, c]
                    yield pd.DataFrame({"block": to}).assign(cell=names[c], q_ids=q_ids[at].tobytes(), q_rows=q[at].tobytes(), kth=kth[at].tobytes())[["cell", "block", "q_ids", "q_rows", "kth"]]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, q_ids, q, ids, x, (at, places, _, _) in searched(batches):
            yield pd.DataFrame({"query_id": q_ids[at], "vec_id": ids[places], "score": pair_scores(q[at], x[places])})

    keys = ["cell", "block"]
    started = materialize(grouped.join(blocks, keys).sortWithinPartitions(*keys).mapInPandas(first, "q_ids binary, q_rows binary, kth binary, query_id binary, vec_id binary, score binary"), "queries")
    sent = started.select("q_ids", "q_rows", "kth").mapInPandas(route, "cell int, block int, q_ids binary, q_rows binary, kth binary")
    found = sent.join(blocks, keys).sortWithinPartitions(*keys).mapInPandas(solve, "query_id long, vec_id long, score double")
    own = started.select("query_id", "vec_id", "score").mapInPandas(met, "query_id long, vec_id long, score double")
    return ranked(found.unionByName(own).dropDuplicates(["query_id", "vec_id"]), k)
