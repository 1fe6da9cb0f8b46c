"""Exact top-k search by inner product: a Voronoi kNN join.

Pivots from a bounded sample cut the space into cells. A summary per cell (how many vectors, how far the farthest
lies from the pivot) bounds every inner product: q.x is within |q| * radius of q.pivot. With the k-th best score
of a bounded sample this gives each query a score that its k best reach at least, and so the cells it needs;
only those are met. Cells are dealt in blocks of bounded size, blocks in parts of up to eight. Queries travel in
packed groups to the parts of the cells that one of them needs, over Spark's shuffle and never by broadcast; each
block is solved by one matrix product, and the blocks' bests are merged.

A query travels to the cells that it needs only, with the score that its results must reach. Where vectors fill the
space evenly the bounds exclude little and every query meets every block; the result is exact all the same.
Quantized components end at 2^62, scores at the range of a long.

Vectors that take no part: see vectors.usable. A table with fewer than k candidates gives all of them; an empty
one, or one without queries, gives no rows. Columns other than vec_id and embedding play no part."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import blocks_a_part, dealt, hash_sample, matrix, met, pack_rows, ranked, unpack_rows, usable

RESULT = "query_id long, rank int, vec_id long, score long"


def choose_pivots(sample: np.ndarray, m: int) -> np.ndarray:
    """Farthest-first from the first row of a sample."""
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(m, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, by floating point where it is exact; what no long can hold is the
    nearest long."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    if most < 2**63:
        return q @ x.T
    limits = np.iinfo(np.int64)
    return np.clip(q.astype(object) @ x.astype(object).T, limits.min, limits.max).astype(np.int64)


def top_pairs(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k highest scores, ties to the smaller id, without its own id and below `least`."""
    fine = (ids[None, :] != own[:, None]) & (scores >= least[:, None])
    if scores.shape[1] > k:
        low = np.where(fine, scores, np.iinfo(np.int64).min)
        fine &= scores >= np.partition(low, -k, axis=1)[:, -k][:, None]
    i, j = np.nonzero(fine)
    order = np.lexsort((ids[j], -scores[i, j].astype(float), i))
    i, j = i[order], j[order]
    # floats order all but neighbours beyond 2^53, so equal ones are put right by the numbers themselves
    order = sorted(range(len(i)), key=lambda t: (i[t], -int(scores[i[t], j[t]]), ids[j[t]])) if np.abs(scores).max(initial=0) > 2**53 else range(len(i))
    i, j = i[list(order)], j[list(order)]
    place = np.arange(len(i)) - np.searchsorted(i, i, "left")
    return i[place < k], j[place < k]


@dataclass(frozen=True)
class Summary:
    """Of each cell its pivot, how many vectors it holds and how far the farthest one lies from the pivot."""

    pivots: np.ndarray
    counts: np.ndarray
    radius: np.ndarray

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lowest and highest inner product that a vector of each cell may have with each query."""
        middle = q.astype(float) @ self.pivots.T
        reach = np.sqrt((q.astype(float) ** 2).sum(axis=1))[:, None] * self.radius[None, :]
        slack = 1e-6 * (1 + np.abs(middle) + reach)
        return middle - reach - slack, middle + reach + slack

    def reached(self, low: np.ndarray, k: int) -> np.ndarray:
        """A score that each query's k best reach at least, by the cells' sizes: one vector may be the query itself."""
        order = np.argsort(-low, axis=1)
        total = np.cumsum(self.counts[order], axis=1)
        enough = (total >= k + 1).argmax(axis=1)
        at = np.take_along_axis(np.take_along_axis(low, order, 1), enough[:, None], 1)[:, 0]
        return np.where(total[:, -1] >= k + 1, at, -np.inf)

    def needed(self, q: np.ndarray, floor: np.ndarray, k: int) -> np.ndarray:
        """Which cells each query needs, given a score that its k best reach in a sample."""
        low, high = self.bounds(q)
        return (high >= np.maximum(floor, self.reached(low, k))[:, None]) & (self.counts > 0)


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, cells: int = 32, sample: int = 2048, block: int = 1024, queries: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score: the k best of every row of `vectors` but the query's own, by the inner
    product of floor(scale * component)."""
    spark = vectors.sparkSession
    rows, dim = usable(vectors)
    if not dim:
        return spark.createDataFrame([], RESULT)

    def quantized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"vec_id": b.vec_id, "v": pack_rows(np.floor(scale * matrix(b.embedding, dim)))})

    whole = materialize(rows.mapInPandas(quantized, "vec_id long, v binary"), "vectors")
    seen = hash_sample(whole, whole.count(), sample)  # `sample` rows at most
    seen_ids, seen_v = np.array([r["vec_id"] for r in seen]), unpack_rows([bytes(r["v"]) for r in seen], dim)
    pivots = choose_pivots(seen_v.astype(float), cells)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = unpack_rows(b.v.tolist(), dim).astype(float)
            d = ((x[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2) if len(x) <= 256 else np.concatenate([((x[i : i + 256, None, :] - pivots[None, :, :]) ** 2).sum(axis=2) for i in range(0, len(x), 256)])
            cell = d.argmin(axis=1)
            yield b.assign(cell=cell.astype("i4"), far=np.sqrt(d[np.arange(len(d)), cell]))

    assigned = materialize(whole.mapInPandas(assign, "vec_id long, v binary, cell int, far double"), "cells")
    rows_of = {r["cell"]: (r["n"], r["far"]) for r in assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # a row per pivot
    summary = Summary(pivots, *(np.array([rows_of.get(c, (0, 0.0))[i] for c in range(len(pivots))]) for i in (0, 1)))
    n_blocks = np.maximum(1, -(-summary.counts // block))
    a_part = blocks_a_part(int(n_blocks.sum()))

    def sampled(ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Each query's k-th best score in the sample."""
        own = products(q, seen_v).astype(float)
        own[ids[:, None] == seen_ids[None, :]] = -np.inf
        return np.partition(own, -k, axis=1)[:, -k] if own.shape[1] > k else np.full(len(q), -np.inf)

    def per_cell(counts: np.ndarray) -> Column:
        return F.element_at(F.array(*[F.lit(int(x)) for x in counts]), F.col("cell") + 1)

    data = assigned.withColumn("block", F.pmod(F.xxhash64("vec_id"), per_cell(n_blocks)).cast("int"))

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("vec_id")
        return pd.DataFrame({"cell": g.cell.iloc[:1], "part": g.block.iloc[:1] // a_part, "ids": [g.vec_id.to_numpy().astype("<i8").tobytes()], "rows": [np.ascontiguousarray(unpack_rows(g.v.tolist(), dim)).tobytes() if g.v.str.len().max() > 2 * dim else b"".join(g.v)]})

    blocks = data.groupBy("cell", "block").applyInPandas(pack, "cell int, part int, ids binary, rows binary")
    asked = assigned.where(is_query)
    share = asked.groupBy("cell").agg(F.count("*").alias("n")).select(F.col("cell").alias("c"), F.ceil(F.col("n") / queries).alias("groups"))
    grouped = asked.join(F.broadcast(share), F.col("cell") == F.col("c")).withColumn("group", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("groups")))  # a row per pivot

    def send(g: pd.DataFrame) -> pd.DataFrame:
        """A group of queries for each cell, to each only those that need it."""
        ids, q = g.vec_id.to_numpy(), unpack_rows(g.v.tolist(), dim)
        floor = sampled(ids, q)
        needed = summary.needed(q, floor, k)
        # whole numbers: scores below the floor are at least one half below it
        least = np.where(np.abs(floor) < 2**52, floor, -np.inf)
        out = []
        for c in np.flatnonzero(needed.any(axis=0)).tolist():
            at = needed[:, c]
            data = q[at].astype("<i8" if np.abs(q[at]).max(initial=0) >= 1 << 15 else "<i2").tobytes()
            out.append((c, ids[at].astype("<i8").tobytes(), data, least[at].tobytes()))
        return pd.DataFrame(out, columns=["cell", "q_ids", "q_rows", "least"])

    packed = dealt(grouped, ["cell", "group"]).groupBy("cell", "group").applyInPandas(send, "cell int, q_ids binary, q_rows binary, least binary")
    sent = packed.withColumn("part", F.explode(F.sequence(F.lit(0), per_cell((n_blocks - 1) // a_part))))

    def read(data: bytes, n: int) -> np.ndarray:
        return np.frombuffer(data, "<i2" if len(data) == 2 * dim * n else "<i8").reshape(n, dim).astype(np.int64)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, data, q_ids, q_data, least in zip(b.ids, b["rows"], b.q_ids, b.q_rows, b.least):
                ids, q_ids = np.frombuffer(ids, "<i8"), np.frombuffer(q_ids, "<i8")
                scores = products(read(q_data, len(q_ids)), read(data, len(ids)))
                i, j = top_pairs(scores, ids, q_ids, k, np.frombuffer(least))
                yield pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[j], "score": scores[i, j]})

    found = met(sent, blocks, ["cell", "part"]).mapInPandas(solve, "query_id long, vec_id long, score long")
    return ranked(found, k)
