"""Best-fit packing of documents into fixed-length sequences by a configuration linear program.

The program has a variable per configuration (a multiset of lengths that fits one sequence) and a covering
constraint per length of the histogram. Multiplicative weights of lengths and amounts of configurations are balanced
against each other, and a knapsack dynamic program prices all configurations at once and gives a dual bound (see
Program). The amounts are rounded down, configurations with large rests are taken once more, the pieces that are left
are a program of their own, and best fit packs what the last one leaves. All of this sees the histogram only, at most
`capacity` numbers whatever the data. Pieces then find their sequence by their rank among the pieces of the same
length, which needs counts per written part and length and no ordering of all rows.

Null and empty texts hold the end id only. Documents longer than the capacity are cut into full pieces and a
rest; no other is cut. Repeated rows are packed one by one; rows with null ids too; columns other than doc_id
and text play no part. An empty table gives no pieces."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, runs
from .encoding import word_encoder

#: A configuration with how often it is used: ((length, copies), ...), times.
Config = tuple[tuple[tuple[int, int], ...], int]


def knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: the highest price of a filling of c; choice[c]: the length that it ends with, 0 where the place
    at c stays empty. prices[l] is -inf for absent lengths."""
    best = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, np.int64)
    top = len(prices) - 1
    back = np.zeros(capacity + 1)  # best, from the end, so that each step reads one run
    for c in range(1, capacity + 1):
        k = min(c, top)
        values = back[capacity - c + 1 : capacity - c + 1 + k] + prices[1 : k + 1]
        i = int(values.argmax())
        if values[i] > best[c - 1]:
            best[c], choice[c] = values[i], i + 1
        else:
            best[c] = best[c - 1]
        back[capacity - c] = best[c]
    return best, choice


def varied(prices: np.ndarray, capacity: int, blur: float, rng: np.random.Generator) -> np.ndarray:
    """The choices of a knapsack program in which each step takes up to `blur` off each price, anew at random, so that
    fillings of nearly the same worth differ from place to place."""
    choice = np.zeros(capacity + 1, np.int64)
    top, last = len(prices) - 1, 0.0
    back = np.zeros(capacity + 1)
    off = rng.random(8 * capacity) * blur
    shift = rng.integers(0, 7 * capacity, capacity + 1)
    for c in range(1, capacity + 1):
        k = min(c, top)
        values = back[capacity - c + 1 : capacity - c + 1 + k] + prices[1 : k + 1]
        i = int((values - off[shift[c] : shift[c] + k]).argmax())
        if values[i] > last:
            choice[c], last = i + 1, values[i]
        back[capacity - c] = last
    return choice


def _fillings(first: np.ndarray, choice: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """column, length and copies of the configurations that hold each of these lengths and are filled up as chosen."""
    down = np.maximum.accumulate(np.where(choice > 0, np.arange(capacity + 1), 0))  # the nearest place where a piece ends
    cols, lengths = [np.arange(len(first))], [first]
    at, room = cols[0], down[capacity - first]
    while len(at):
        k = choice[room]
        at, room, k = at[k > 0], room[k > 0], k[k > 0]
        cols.append(at)
        lengths.append(k)
        room = down[room - k]
    key, copies = np.unique(np.concatenate(cols) * (capacity + 1) + np.concatenate(lengths), return_counts=True)
    return key // (capacity + 1), key % (capacity + 1), copies


class Program:
    """The configuration program over one histogram: minimise the sum of amounts of configurations such that each
    length l is covered histogram[l] times.

    Both sides are multiplicative weights. A length's weight grows while its pieces are covered less than once and
    falls while they are covered more; a configuration's amount grows while the prices of its pieces (weight per
    piece) sum to more than one sequence and falls while they sum to less. Steps are optimistic, i.e. each counts
    the last change twice, and need no width: coverages and worths are one where the program is solved.

    Each round prices all configurations at once by a knapsack program. The prices lie between the weights and
    those with the best dual bound so far, which keeps them from swinging; ties are broken anew at every step of a
    second program, so that a round finds many different configurations, one for each length. Those that are worth
    more than a sequence join the pool; those whose amounts have all but vanished leave it.

    `value` is that of the best feasible cover, which is the amounts scaled, with lengths that fall short filled up
    by sequences of one length; no cover has less than `bound`."""

    STEP, SWEEPS, BLUR, FADE = 0.5, 80, 0.03, 0.95
    CENTRE = (0.97, 0.9, 0.7, 0.9)  # how far prices lie towards the best ones so far, in turn

    def __init__(self, histogram: np.ndarray, capacity: int, seed: int = 7):
        self.capacity, self.present = capacity, np.flatnonzero(histogram)
        self.need = histogram[self.present].astype(float)
        self.m, self.rng = len(self.present), np.random.default_rng(seed)
        self.position = np.full(capacity + 1, -1)
        self.position[self.present] = np.arange(self.m)
        self.mark = self.rng.integers(0, 1 << 62, capacity + 1, dtype=np.uint64)  # a configuration's is the sum of its pieces'
        per = capacity // self.present if self.m else self.present
        self.alone = 1.0 / per
        # the pool: pieces of all configurations in a row, `start` where each begins; first those of one length
        self.row, self.copies, self.start = np.arange(self.m), per.astype(float), np.arange(self.m)
        self.marks = self.mark[self.present] * per.astype(np.uint64)
        self.amount = self.need * self.alone
        self.weight = self.need * self.present / capacity  # prices in proportion to lengths: the bound by volume
        self.centre = self.weight
        self.value, self.bound, self.turn = 0.0, 0.0, 0
        self._spread()
        self.best = (self.row, self.copies, self.start, self.amount)

    def _spread(self, passes: int = 60) -> None:
        """A first cover by steps that no length can outgrow: configurations under the first prices, one for each
        length that is still there, are used while their pieces last, the longest first; then prices count only for
        what is left. Each step ends a length or nearly so, so the pool stays about as small as the histogram."""
        left = np.zeros(self.capacity + 1, np.int64)
        left[self.present] = self.need.astype(np.int64)
        parts: dict[tuple, int] = {}
        for _ in range(passes):
            there = np.flatnonzero(left)[::-1]
            if not len(there):
                break
            prices = np.full(self.capacity + 1, -np.inf)
            prices[there] = there
            column, length, copies = _fillings(there, varied(prices, self.capacity, 0.5, self.rng), self.capacity)
            begin = np.append(np.flatnonzero(np.append(True, column[1:] != column[:-1])), len(column))
            for i, j in zip(begin[:-1].tolist(), begin[1:].tolist()):
                k, c = length[i:j], copies[i:j]
                if times := int((left[k] // c).min()):
                    left[k] -= times * c
                    key = (tuple(k.tolist()), tuple(c.tolist()))
                    parts[key] = parts.get(key, 0) + times
        rest = left[self.present] * self.alone
        self.value = float(rest.sum()) + sum(parts.values())
        self.amount = np.maximum(rest, 0.01)
        for j, (k, per) in enumerate(zip(self.present.tolist(), self.copies.astype(int).tolist())):
            self.amount[j] += parts.pop(((k,), (per,)), 0)  # in the pool from the start
        if parts:
            sizes = np.array([len(k) for k, _ in parts])
            begin = np.cumsum(sizes) - sizes
            k, c = (np.concatenate([key[i] for key in parts]) for i in (0, 1))
            self.start = np.append(self.start, len(self.row) + begin)
            self.row, self.copies = np.append(self.row, self.position[k]), np.append(self.copies, c.astype(float))
            self.marks = np.append(self.marks, np.add.reduceat(self.mark[k] * c.astype(np.uint64), begin))
            self.amount = np.append(self.amount, np.array(list(parts.values()), float))

    def _ends(self) -> np.ndarray:
        return np.append(self.start[1:], len(self.row))

    def bounded(self) -> float:
        """The bound under the first prices, before any round."""
        self._price()
        return self.bound

    def _price(self) -> None:
        toward = self.CENTRE[self.turn % len(self.CENTRE)]
        mixed = toward * self.centre + (1 - toward) * self.weight * (self.centre.sum() / self.weight.sum())
        prices = np.full(self.capacity + 1, -np.inf)
        prices[self.present] = mixed / self.need
        best, _ = knapsack(prices, self.capacity)
        dearest = best[self.capacity]
        if (bound := float(mixed.sum() / dearest)) > self.bound:
            self.bound, self.centre = bound, mixed / dearest
        near = self.present[prices[self.present] + best[self.capacity - self.present] >= 0.95 * dearest]
        for _ in range(3):
            self._add(near, varied(prices, self.capacity, dearest * self.BLUR * self.FADE**self.turn, self.rng))

    def _add(self, first: np.ndarray, choice: np.ndarray) -> None:
        column, length, copies = _fillings(first, choice, self.capacity)
        marks = np.zeros(len(first), np.uint64)
        np.add.at(marks, column, self.mark[length] * copies.astype(np.uint64))
        worth = np.bincount(column, copies * (self.weight / self.need)[self.position[length]], len(first))
        _, once = np.unique(marks, return_index=True)
        once = once[(worth[once] > 1.0005) & ~np.isin(marks[once], self.marks)]
        keep = np.isin(column, once)
        if not keep.any():
            return
        column, row, copies = column[keep], self.position[length[keep]], copies[keep].astype(float)
        begin = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
        self.amount = np.append(self.amount, 0.01 * np.minimum.reduceat(self.need[row] / copies, begin))
        self.start = np.append(self.start, len(self.row) + begin)
        self.row, self.copies = np.append(self.row, row), np.append(self.copies, copies)
        self.marks = np.append(self.marks, marks[column[begin]])

    def _balance(self) -> None:
        share = self.copies / self.need[self.row]
        column = np.repeat(np.arange(len(self.start)), self._ends() - self.start)
        most = np.minimum.reduceat(1.0 / share, self.start)  # no configuration is of use more often
        x, u = np.minimum(self.amount, most), self.weight

        def seen() -> tuple[np.ndarray, np.ndarray]:
            return np.add.reduceat(share * u[self.row], self.start), np.bincount(self.row, share * x[column], self.m)

        worth, cover = seen()
        mean_x, mean_u, half = np.zeros_like(x), np.zeros_like(u), self.SWEEPS // 2
        for i in range(self.SWEEPS):
            last_worth, last_cover = worth, cover
            worth, cover = seen()
            x = np.minimum(x * np.exp(np.clip(self.STEP * (2 * worth - last_worth - 1), -0.5, 0.5)), most)
            u = u * np.exp(np.clip(self.STEP * (1 - 2 * cover + last_cover), -0.5, 0.5))
            if i >= half:
                mean_x += x / (self.SWEEPS - half)
                mean_u += u / (self.SWEEPS - half)
        for amount in (mean_x, x):
            cover = np.bincount(self.row, share * amount[column], self.m)
            scales = np.unique(np.quantile(cover, [0, 0.02, 0.1, 0.25, 0.5, 0.9]))
            for s in scales[scales > 1e-3].tolist():
                value = float(amount.sum() / s + (np.maximum(0, 1 - cover / s) * self.need * self.alone).sum())
                if value < self.value:
                    self.value, self.best = value, (self.row, self.copies, self.start, amount / s)
        self.amount, self.weight = mean_x, mean_u
        live = (mean_x > 1e-4 * most) | (np.arange(len(most)) < self.m)
        sizes = self._ends() - self.start
        pieces = np.repeat(live, sizes)
        self.row, self.copies, self.marks, self.amount = self.row[pieces], self.copies[pieces], self.marks[live], self.amount[live]
        self.start = np.append(0, np.cumsum(sizes[live])[:-1])

    def round(self) -> None:
        self._price()
        self._balance()
        self.turn += 1

    def cover(self) -> tuple[list[tuple[tuple[int, int], ...]], np.ndarray]:
        """Configurations of the best cover and their amounts, those that only fill up left out."""
        row, copies, start, amount = self.best
        lengths, copies = self.present[row].tolist(), copies.astype(np.int64).tolist()
        ends = np.append(start[1:], len(row)).tolist()
        return [tuple(zip(lengths[i:j], copies[i:j])) for i, j in zip(start.tolist(), ends)], amount


@dataclass
class Solution:
    """Whole configurations; best fit opened `rest` of their sequences for pieces that the rounded covers left."""

    configs: list[Config]
    rest: int
    value: float
    bound: float
    rounds: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.configs)


def taken(left: np.ndarray, configs: list[tuple[tuple[int, int], ...]], amount: np.ndarray, least: float) -> list[Config]:
    """Whole configurations while their pieces last, which go from `left`: amounts are rounded down, then those with
    a rest above `least` are taken once more, the largest rests first."""
    whole = np.floor(amount + 1e-9).astype(np.int64)
    rest = amount - whole
    once = np.argsort(-rest, kind="stable")
    used: dict[int, int] = {}
    for j, times in [(j, int(whole[j])) for j in np.flatnonzero(whole).tolist()] + [(j, 1) for j in once[rest[once] > least].tolist()]:
        if times := min([times, *[int(left[k]) // a for k, a in configs[j]]]):
            for k, a in configs[j]:
                left[k] -= a * times
            used[j] = used.get(j, 0) + times
    return [(configs[j], n) for j, n in used.items()]


def fractional(histogram: np.ndarray, capacity: int, rounds: int = 80, gap: float = 0.0005) -> Program:
    """The program in rounds, until the cover is within `gap` of the bound, or within the sequence that both end in."""
    program = Program(histogram, capacity)
    while program.m and program.turn < rounds and program.value > max(program.bound * (1 + gap), np.ceil(program.bound - 1e-6)):
        program.round()
    return program


def rounded(histogram: np.ndarray, capacity: int, rounds: int = 80, gap: float = 0.0005) -> Solution:
    """The program is solved and rounded, then solved anew for the pieces that are left, while each such turn places a
    tenth of them; best fit packs the rest. Turns look ahead: whenever what is chosen, with best fit's
    packing of the rest, is within `gap` of the bound or at the bound rounded up, that stands."""
    left = histogram.astype(np.int64).copy()
    chosen: list[Config] = []
    found: list[Solution] = []
    value = bound = turns = 0

    def attempt(program: Program, least: float) -> tuple[list[Config], np.ndarray]:
        after = left.copy()
        some = taken(after, *program.cover(), least)
        configs = best_fit(after, capacity, chosen + some)
        opened = sum(n for _, n in configs) - sum(n for _, n in chosen + some)
        found.append(Solution(configs, opened, value or program.value, max(bound, program.bound), turns + program.turn))
        return some, after

    def done() -> bool:
        return min(s.sequences for s in found) <= max(bound * (1 + gap), np.ceil(bound - 1e-6))

    while left.any():
        program = Program(left, capacity)
        first = not chosen
        if first:
            bound = program.bounded()
            attempt(program, 0.0)
            if done():
                break
        limit = rounds if first else rounds // 4
        while program.turn < limit and program.value > max(program.bound * (1 + gap), np.ceil(program.bound - 1e-6)):
            program.round()
            if first:
                bound = program.bound
                if program.turn in (5, 10, 20, 40):
                    attempt(program, 0.0)
                    if done():
                        break
        value = value or program.value
        if first and found and done():
            break
        attempt(program, 0.0)
        some, after = attempt(program, 0.5)
        placed = (left - after).sum()
        turns += program.turn
        if done() or placed * 10 < left.sum():
            break
        chosen, left = chosen + some, after
    return min(found, key=lambda s: s.sequences) if found else Solution([], 0, 0.0, 0.0, 0)


def solve(histogram: np.ndarray, capacity: int, rounds: int = 80) -> list[Config]:
    """Configurations that hold histogram[l] pieces of each length l exactly."""
    left = np.zeros(capacity + 1, np.int64)
    left[: len(histogram)] = histogram
    full = [(((capacity, 1),), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    solution = rounded(left, capacity, rounds)
    return full + solution.configs


def best_fit(left: np.ndarray, capacity: int, opened: list[Config] = []) -> list[Config]:
    """Best fit, decreasing: each piece into the fullest sequence that takes it, those opened before too. Runs of one
    length that meet only empty sequences are placed in one step, so the work follows the lengths, not the pieces."""
    rooms: list[tuple[int, int]] = []  # (room, sequence)
    sequences: list[list[int]] = []
    times: list[int] = []
    for config, n in opened:
        rooms.append((capacity - sum(k * a for k, a in config), len(sequences)))
        sequences.append([k for k, a in config for _ in range(a)])
        times.append(n)
    rooms.sort()
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            at = bisect_left(rooms, (length, -1))
            if at < len(rooms):
                room, s = rooms.pop(at)
                if times[s] > n:  # open only as many of these equal sequences as there are pieces
                    insort(rooms, (room, len(sequences)))
                    sequences.append(list(sequences[s]))
                    times.append(times[s] - n)
                    times[s] = n
                n -= times[s]
            else:
                per = capacity // length
                whole, rest = divmod(n, per)
                s, room, n = len(sequences), capacity, 0
                if whole:
                    sequences.append([length] * per)
                    times.append(whole)
                    insort(rooms, (capacity - per * length, s))
                if rest:
                    sequences.append([length] * rest)
                    times.append(1)
                    insort(rooms, (capacity - rest * length, len(sequences) - 1))
                continue
            sequences[s].append(length)
            insort(rooms, (room - length, s))
    out = []
    for items, t in zip(sequences, times):
        counts: dict[int, int] = {}
        for k in items:
            counts[k] = counts.get(k, 0) + 1
        out.append((tuple(sorted(counts.items(), reverse=True)), t))
    return out


class Places:
    """Where the r-th piece of a length goes: runs of ranks, each `copies` in a row to one sequence."""

    def __init__(self, configs: list[Config]):
        rows, sequence = [], 0
        taken: dict[int, int] = {}
        for config, times in configs:
            offset = 0
            for length, copies in config:
                rank = taken.get(length, 0)
                rows.append((length, rank, copies, sequence, offset))
                taken[length] = rank + copies * times
                offset += length * copies
            sequence += times
        rows.sort()
        self.length, self.rank, self.copies, self.sequence, self.offset = (np.array(x, np.int64) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
        self.key = (self.length << 44) + self.rank
        self.sequences = sequence

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, (length << 44) + rank, "right") - 1
        nth = rank - self.rank[i]
        return self.sequence[i] + nth // self.copies[i], self.offset[i] + nth % self.copies[i] * length


def pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int, kept: int) -> DataFrame:
    """Each document's pieces with the part that made them and their rank among its pieces of the same length."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = word_encoder(tokenizer, kept)
        end = np.array([end_id], encoder.dtype).tobytes()
        width, part, seen = encoder.dtype.itemsize, TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            names, texts = b.doc_id.tolist(), b.text.tolist()
            rows = []
            for at, to in runs(texts):
                for name, ids in zip(names[at:to], encoder.encode(texts[at:to])):
                    ids = np.frombuffer(ids + end, encoder.dtype).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        piece = ids[start : start + capacity]
                        rows.append((name, k, start, len(piece), zlib.crc32(piece.tobytes()), part, seen[len(piece)]))
                        seen[len(piece)] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(docs: DataFrame, capacity: int = 4096, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, rounds: int = 80, kept: int = 1_000_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece. `kept`: words that a Python
    worker keeps at most, about 200 bytes each."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, capacity, tokenizer, end_id, kept), "pieces")
    counts = materialize(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        histogram[r["length"]] = r["n"]
    places = spark.sparkContext.broadcast(Places(solve(histogram, capacity, rounds)))  # some rows per configuration in use, rounds * capacity at most
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequence, offset = places.value.find(b.length.to_numpy(), b["rank"].to_numpy())
            yield b[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence, offset=offset)

    out = ranked.mapInPandas(place, "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
