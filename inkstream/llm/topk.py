"""Operator 7: exact top-k search by inner product, without random access.

Vectors of integers are dealt to blocks; every block of queries meets every block of candidates. In a block, each
dimension has a list of the candidates sorted by that component. All lists are read sequentially from both ends at the
same pace, and every product read is added to the partial sums of the candidates it belongs to. A component that was not
read lies between the two entries that its list would give next; by the Cauchy-Schwarz inequality, this bounds what a
candidate's unread products add or take away. A candidate whose upper bound is below the k-th best lower bound cannot
qualify. Reading stops when few candidates can; their scores are resolved exactly. Blocks' winners are merged for each
query.

Vectors travel packed, in the least of 2, 4 or 8 bytes a component that holds a row. What the blocks' meeting shuffles is
each candidate once for every ``QUERIES`` queries and each query once for every ``CANDIDATES`` candidates.

Results: k best for each query, ties to the smaller id; all if there are fewer. Null vectors, and vectors with null or
non-finite components, take no part; vectors of another dimension than the query's are no candidates. Repeated rows
stay repeated, as in ``SQL``: each copy of a candidate takes a rank, and each copy of a query meets all candidates.
Scores beyond 64 bits are compared exactly and returned as the nearest 64-bit integer.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstream.llm.clusters import pack, unpack
from inkstream.session import partitions

#: Candidates and queries in a block, at most; into how many steps the reading of a list is cut.
CANDIDATES, QUERIES, STEPS = 65536, 131072, 8


class Lists:
    """A block of candidates, and its lists sorted by each dimension.

    Components are taken relative to their list's median, which moves all scores of a query alike, so that values in
    the middle of a list, which are read last, are small. How far lists were read is the same for all queries, so a block
    of queries shares the reading. ``read`` counts the list entries read.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        n, dims = vectors.shape
        self.lists = np.argsort(self.vectors, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(self.vectors, self.lists.T, axis=0).T
        if n and not self._fits(self.values, self.values):
            self.values = self.values.astype(object)
        self.values = self.values - self.values[:, n // 2, None] if n else self.values
        self.place = np.empty_like(self.lists)
        np.put_along_axis(self.place, self.lists, np.arange(n)[None, :], axis=1)
        self.read = 0

    @staticmethod
    def _fits(x: np.ndarray, y: np.ndarray, bits: int = 62) -> bool:
        """True if inner products, and differences of components, stay below so many bits."""
        most = lambda v: max((abs(int(e)) for e in (v.min(), v.max())), default=0) if v.size else 0
        return 2 * most(x) * max(2 * most(y), 1) * max(1, len(x)) < 1 << bits

    def best(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of each query's k best, best first."""
        out, step = [], max(8, (1 << 19) // max(1, len(self.ids)))
        for at in range(0, len(queries), step):
            out += self._some(queries[at : at + step], own[at : at + step], k)
        return out

    def _some(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        n, dims = self.vectors.shape
        q = queries.T
        kind = np.int32 if self._fits(self.values, q, 30) else np.int64 if self._fits(self.values, q) else object
        q, values = q.astype(kind), self.values.astype(kind)
        norms = np.sqrt((q.astype(float) ** 2).sum(axis=0))
        partial = np.zeros((n, len(queries)), kind)
        outside = self.ids[:, None] == own[None, :]
        rest = ~outside
        a, b, step = 0, n, max(1, -(-n // (2 * STEPS)))
        while a < b:
            c, d = min(a + step, b), max(b - step, min(a + step, b))
            for i in range(dims):
                for x, y in ((a, c), (d, b)):
                    partial[self.lists[i, x:y]] += values[i, x:y, None] * q[i]
            self.read += dims * (c - a + b - d) * len(queries)
            a, b = c, d
            if a == b or 2 * (n - b + a) < n:
                continue
            wide = np.maximum(np.abs(values[:, a].astype(float)), np.abs(values[:, b - 1].astype(float)))
            unread = ((self.place >= a) & (self.place < b)).T @ wide**2
            slack = np.sqrt(unread)[:, None] * norms
            slack += 1e-9 * slack + 1e-12 * max(1.0, float(np.abs(partial).max(initial=0)))
            sums = partial.astype(float)
            lower = np.where(outside, -np.inf, sums - slack)
            bar = np.partition(lower, n - k, axis=0)[n - k] if n >= k else np.full(len(queries), -np.inf)
            rest = ~outside & (sums + slack >= bar)
            if rest.sum() * 24 <= rest.size:
                break
        out = []
        wide = not self._fits(self.vectors, queries)
        for j, (o, whole) in enumerate(zip(own, queries, strict=True)):
            at = np.flatnonzero(rest[:, j])
            x = self.vectors[at]
            out.append(self._first(at, (x.astype(object) if wide else x) @ (whole.astype(object) if wide else whole), k))
        return out

    def _first(self, rest: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of some candidates with their resolved scores."""
        if scores.dtype == object:
            at = sorted(range(len(rest)), key=lambda i: (-scores[i], self.ids[rest[i]]))[:k]
            return self.ids[rest[at]], np.array([max(-(1 << 63), min((1 << 63) - 1, scores[i])) for i in at], np.int64)
        at = np.lexsort((self.ids[rest], -scores))[:k]
        return self.ids[rest[at]], scores[at].astype(np.int64)


def usable(column: str) -> Column:
    """True for vectors without null or non-finite components."""
    return F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def scaled(column: str, factor: int) -> Column:
    """floor(factor * x) of each component x, taken as double."""
    return F.transform(column, lambda x: F.floor(x.cast("double") * factor).cast("long"))


def _packed(vectors: pa.Array) -> pa.Array:
    """Each vector as bytes."""
    out: list[bytes] = [b""] * len(vectors)
    widths = np.array(vectors.value_lengths().to_pylist(), np.int64)
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        if width:
            for i, cell in zip(at.tolist(), pack(vectors.take(pa.array(at)).flatten().to_numpy().reshape(-1, width)), strict=True):
                out[i] = cell
    return pa.array(out, pa.binary())


def search(vectors: DataFrame, queries: Column, k: int, vec_id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """Columns query_id, rank (from 1), vec_id, score: for rows where ``queries`` holds, against all other rows.

    ``vector`` is an array of long. One query's own id is left out of its candidates.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), queries.alias("asks")).where("vec_id IS NOT NULL").withColumn("width", F.size("vector"))
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    rows = rows.withColumn("vector", F.arrow_udf(_packed, "binary")("vector"))
    blocks, groups = max(1, math.ceil(n / CANDIDATES), min(partitions(vectors.sparkSession), n // 1024)), max(1, math.ceil(asked / QUERIES))
    deal = lambda m: F.pmod(F.xxhash64("vec_id", "vector", F.spark_partition_id()), F.lit(m)).cast("int")  # noqa: E731  repeated rows go to many blocks
    candidates = rows.withColumn("block", deal(blocks)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("width", "block", "part", "vec_id", "vector")
    asking = rows.where("asks").withColumn("part", deal(groups)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("width", "block", "part", "vec_id", "vector")

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return table.column("vec_id").to_numpy().astype(np.int64), unpack(table.column("vector").to_pylist(), table.column("width")[0].as_py() if table.num_rows else 0)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            lists = Lists(*matrix(right))
            asking, wanted = matrix(left)
            for own, (ids, scores) in zip(asking, lists.best(wanted, asking, k), strict=True):
                out[0].append(np.full(len(ids), own))
                out[1].append(ids)
                out[2].append(scores)
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"query_id": join(out[0]), "vec_id": join(out[1]), "score": join(out[2])})

    keys = ("width", "block", "part")
    found = asking.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The query for DuckDB: all scores of the queries, then the five best.
SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(c.x) + 1), lambda i: c.x[i] * q.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
