"""Operator 4: best-fit packing of token sequences.

Documents become pieces of at most the capacity. Only the histogram of piece lengths (one number for each length) goes
to the driver. There the configuration linear program (cover the histogram with the fewest patterns, a pattern being a
multiset of lengths that fits) is solved by multiplicative weights: a weight for each length prices it, and weights fall
as lengths are covered. A knapsack dynamic program over all rooms at once prices patterns; its table gives, for each
length, the pattern of highest price that holds it. Each round buys of these as much as no length's count forbids, until
the cover is whole. The prices of every round also bound the optimum from below. The fractional solution is rounded down
to whole patterns; what is left is a smaller program, which is solved and rounded again, and best fit places the last
few items, into the room that rounding left open first. The plan's size depends on the capacity, not on the number of
pieces.

Each length's pieces are numbered (a count for each task and length, then a running sum), and a piece's number looks
up its place in the plan. Pieces are written to the shared folder first, which fixes each task's rows.

Results: a null text counts as empty and becomes one piece that holds the end token alone; rows that repeat are packed
each; a very long text becomes many pieces. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstream.llm import columns, tokens
from inkstream.session import materialise

#: Rounds of multiplicative weights for one program, at most; how strongly covered lengths lose weight; and how often
#: what rounding left is solved anew.
ROUNDS, RATE, PASSES = 50, 1.0, 5
_SHIFT = 1 << 44

Plan = list[tuple[dict[int, int], int]]


def pieces(docs: DataFrame, path: str, capacity: int, end: int) -> DataFrame:
    """Columns doc_id, piece, start, length, ids_crc32, and the task's number and each piece's rank among those of its
    length in that task."""

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = tokens.load(path), TaskContext.get().partitionId()
        before = np.zeros(capacity + 1, np.int64)
        for table in tables:
            for part, data, offsets in tokens.balanced(table):
                row, piece, start, length, crc = [], [], [], [], []
                ids, edges = encoder.all_ids(data, offsets)
                ids = np.insert(ids, edges[1:], end).astype("<u4")
                edges = edges + np.arange(len(edges))
                for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                    for k, at in enumerate(range(a, b, capacity)):
                        some = ids[at : min(b, at + capacity)]
                        row.append(i)
                        piece.append(k)
                        start.append(at - a)
                        length.append(len(some))
                        crc.append(zlib.crc32(some))
                sizes = np.array(length, np.int64)
                order = np.argsort(sizes, kind="stable")
                first = np.searchsorted(sizes[order], sizes[order])
                rank = np.empty(len(sizes), np.int64)
                rank[order] = np.arange(len(sizes)) - first
                rank += before[sizes]
                before += np.bincount(sizes, minlength=capacity + 1)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(sizes), "ids_crc32": pa.array(crc, pa.int64()), "task": pa.array(np.full(len(row), task, np.int32)), "rank": pa.array(rank)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long")


def knapsack(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each room, the highest total price of items that fit, and the length to take first (0: leave one token).

    ``prices`` holds a price for each length from 0 on, ``-inf`` where there is none.
    """
    capacity = len(prices) - 1
    best, chosen = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    down, values = prices[::-1].copy(), np.empty(capacity + 1)
    for room in range(1, capacity + 1):
        v = np.add(best[:room], down[capacity - room : capacity], out=values[:room])  # of lengths room, room - 1, ..., 1
        k = int(v.argmax())  # of equals the longest: short items fit later
        if v[k] > best[room - 1] + 1e-12:
            best[room], chosen[room] = v[k], room - k
        else:
            best[room] = best[room - 1]
    return best, chosen


def fractional(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Patterns and multiplicities that cover the histogram, and a lower bound on any cover.

    A length's price is its share of a sequence times a weight that falls with the share of its count that is covered.
    Of every length, longest first, as much of the best pattern that holds it is bought as keeps all lengths within
    their counts. The rest, if rounds run out, is covered by patterns of one length.
    """
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.zeros(capacity + 1)
    counts[lengths] = [histogram[x] for x in lengths.tolist()]
    rest, bought, bound = counts.copy(), Counter(), 0.0
    for _ in range(rounds):
        open_ = np.flatnonzero(rest > 1e-9)
        if not len(open_):
            break
        prices = np.full(capacity + 1, -np.inf)
        share = open_ / capacity
        prices[open_] = share * (1 + 1e-9 * share) * np.exp(RATE * (rest[open_] / counts[open_] - 1))  # long items win ties
        best, chosen = knapsack(prices)
        bound = max(bound, float(counts[open_] @ prices[open_]) / best[capacity])
        for length in open_[::-1].tolist():
            if rest[length] <= 1e-9:
                continue
            pattern, room = {length: 1}, capacity - length
            while room > 0:
                if not (x := int(chosen[room])):
                    room -= 1
                    continue
                pattern[x] = pattern.get(x, 0) + 1
                room -= x
            amount = min(rest[x] / n for x, n in pattern.items())
            if amount >= 1:  # whole multiplicities lose nothing when they are rounded
                amount = float(int(amount))
            if amount > 1e-9:
                bought[tuple(sorted(pattern.items()))] += amount
                for x, n in pattern.items():
                    rest[x] -= n * amount
    for length in np.flatnonzero(rest > 1e-9).tolist():
        many = capacity // length
        bought[((length, many),)] += rest[length] / many
    return [(dict(key), amount) for key, amount in bought.items()], bound


def best_fit(rest: dict[int, int], capacity: int, given: Plan = ()) -> Plan:
    """Best fit, longest first, over a histogram, into the room of the given patterns and into new ones; equal items into
    equal sequences are placed together."""
    rooms: list[list[tuple[dict[int, int], int]]] = [[] for _ in range(capacity + 1)]
    there = bytearray(capacity + 1)  # rooms that some sequence has

    def put(room: int, pattern: dict[int, int], count: int) -> None:
        rooms[room].append((pattern, count))
        there[room] = 1

    for pattern, count in given:
        put(capacity - sum(x * n for x, n in pattern.items()), pattern, count)
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            room = there.find(1, length)
            if room < 0:
                each = capacity // length
                full, more = divmod(n, each)
                for many, count in ((each, full), (more, 1 if more else 0)):
                    if count:
                        put(capacity - many * length, {length: many}, count)
                break
            pattern, count = rooms[room].pop()
            there[room] = bool(rooms[room])
            used = min(n, count)
            if used < count:
                put(room, pattern, count - used)
            put(room - length, pattern | {length: pattern.get(length, 0) + 1}, used)
            n -= used
    return [x for made in rooms for x in made]


@dataclass(frozen=True)
class Solved:
    """A plan, the fractional cover's size, the lower bound, and how many sequences come from rounded patterns.

    The program's optimum lies between the bound and the smaller of ``fractional`` and ``sequences``, the plan itself being
    a cover.
    """

    plan: Plan
    fractional: float
    bound: float
    rounded: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.plan)


def solve(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> Solved:
    """Patterns with whole multiplicities that use every item of the histogram exactly once.

    Of a pass, patterns count that are full up to a few hundredths of the capacity, one more each pass, and all of them in
    the last; emptier ones go to the next program. Best fit may take over after any pass: the fewest sequences win, and of
    equals the most rounded patterns.
    """
    rest = {x: n for x, n in histogram.items() if n}
    whole = sum(x * n for x, n in rest.items())
    size, bound, plan, ways = 0.0, float(max(-(-whole // capacity), sum(n for x, n in rest.items() if 2 * x > capacity))), [], [(rest, [])]
    for k in range(PASSES):
        if not rest:
            break
        found, low = fractional(rest, capacity, rounds)
        if k == 0:
            size, bound = sum(amount for _, amount in found), max(bound, low)
        more, rest = _whole(found, rest, (100 - k) * capacity if k < PASSES - 1 else 0)
        plan = plan + more
        ways.append((rest, plan))
    made = [(best_fit(rest, capacity, plan), plan) for rest, plan in ways]
    out, kept = min(made, key=lambda w: (sum(n for _, n in w[0]), -sum(n for _, n in w[1])))
    return Solved(out, size, bound, sum(n for _, n in kept))


def _whole(found: list[tuple[dict[int, int], float]], rest: dict[int, int], least: int) -> tuple[Plan, dict[int, int]]:
    """Whole multiplicities of the patterns that fill ``least`` hundredths of a token count or more, fullest first; and
    what is left."""
    out, rest = [], dict(rest)
    for pattern, amount in sorted(found, key=lambda x: (-sum(a * b for a, b in x[0].items()), sorted(x[0].items(), reverse=True))):
        n = min(int(amount + 1e-6), *(rest.get(x, 0) // m for x, m in pattern.items()))
        if n > 0 and 100 * sum(x * m for x, m in pattern.items()) >= least:
            out.append((pattern, n))
            for x, m in pattern.items():
                rest[x] -= n * m
    return out, {x: n for x, n in rest.items() if n}


class Places:
    """Where the k-th piece of each length goes."""

    def __init__(self, plan: Plan):
        rows, used, sequence = [], Counter(), 0
        for pattern, count in plan:
            offset = 0
            for length in sorted(pattern, reverse=True):
                each = pattern[length]
                rows.append((length * _SHIFT + used[length], length, each, sequence, offset))
                used[length] += count * each
                offset += length * each
            sequence += count
        self.keys, self.length, self.each, self.sequence, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
        self.sequences = sequence

    def find(self, length: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, by length and number."""
        at = np.searchsorted(self.keys, length * _SHIFT + k, side="right") - 1
        nth = length * _SHIFT + k - self.keys[at]
        return self.sequence[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


def pack(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row for each piece."""
    docs = columns.plain(docs, "doc_id", "text").select("doc_id", "text")
    made = materialise(pieces(docs, path, capacity, end), "pieces")
    counts = made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    sums = materialise(counts, "piece-counts")
    histogram = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    places = made.sparkSession.sparkContext.broadcast(Places(solve(histogram, capacity, rounds).plan))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    numbered = made.join(base, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("k"))

    def batches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            sequence, offset = places.value.find(batch.column("length").to_numpy(), batch.column("k").to_numpy())
            kept = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], names=[*kept.schema.names, "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return numbered.mapInArrow(batches, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
