"""Operator 12: centroid clustering of quantised vectors, by weighted deduplication.

Vectors of integers are packed to bytes and identical ones grouped with their multiplicity; tasks combine copies before
the shuffle. Lloyd's rounds run on the distinct vectors: each task assigns its own to the nearest centroid and adds up
multiplicity times vector for each cluster, as two halves of 32 bits so that sums of any length stay exact; one row a
cluster and task is shuffled. The centroids are all that the driver holds. Last, the assignments of distinct vectors are
joined back to the ids. Vectors with more than a thousandth of all rows are at most a thousand; theirs are broadcast, so
no task gathers the rows of a frequent vector.

Results: one row a vector that takes part. Null vectors, vectors of another number of components, and those with null or
non-finite components take no part. Repeated rows count and are returned each. Rows without an id are clustered and
returned, but start centroids after all others; equal hashes go by id and vector. With fewer vectors than clusters there
are as many clusters as vectors. Ties go to the smaller number, so centroids that are equal to an earlier one stay empty.
Components beyond 64 bits count as the nearest 64-bit integer; distances and inertias beyond 64 bits are returned so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm import columns
from inkstream.session import discard, materialise

#: Vectors with more than one in so many rows are joined by broadcast; vectors of a block in a task.
FREQUENT, BLOCK = 1000, 8192
_LONG = (1 << 63) - 1


def floors(x: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * x) of doubles, as 64-bit integers."""
    scaled = np.floor(x.astype(np.float64) * factor)
    out = np.clip(scaled, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    out[scaled >= 2.0**63] = _LONG
    return out


def pack(rows: np.ndarray) -> list[bytes]:
    """Each row in the least of 2, 4 or 8 bytes a component; equal rows give equal bytes."""
    most = np.maximum(rows.max(axis=1), ~rows.min(axis=1)) if rows.shape[1] else np.zeros(len(rows), np.int64)
    out: list[bytes] = [b""] * len(rows)
    for kind, low, high in (("<i2", -1, 1 << 15), ("<i4", 1 << 15, 1 << 31), ("<i8", 1 << 31, None)):
        at = np.flatnonzero((most >= low) & (most < high if high else True))
        raw, width = rows[at].astype(kind).tobytes(), rows.shape[1] * int(kind[2])
        for n, i in enumerate(at.tolist()):
            out[i] = raw[n * width : (n + 1) * width]
    return out


def unpack(cells: list[bytes], dims: int) -> np.ndarray:
    """Rows of 64-bit integers."""
    if not dims:
        return np.zeros((len(cells), 0), np.int64)
    out = np.empty((len(cells), dims), np.int64)
    sizes = np.array([len(c) for c in cells])
    for width in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == width)
        out[at] = np.frombuffer(b"".join(cells[i] for i in at.tolist()), f"<i{width // dims}").reshape(-1, dims)
    return out


def quantised(vectors: DataFrame, dims: int, factor: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Columns vec_id, vector (packed floors of factor * x) of the vectors that take part."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                column = part.column("vector")
                good = np.flatnonzero(np.array([n == dims for n in column.value_lengths().to_pylist()], bool))
                column, ids = column.take(pa.array(good)), part.column("vec_id").take(pa.array(good))
                x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # nulls become NaN
                whole = np.flatnonzero(np.isfinite(x).all(axis=1))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(whole)), pa.array(pack(floors(x[whole], factor)), pa.binary())], names=["vec_id", "vector"])

    plain = columns.plain(vectors, vec_id, vector).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    return plain.where("vector IS NOT NULL").mapInArrow(rows, "vec_id long, vector binary")


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's nearest centroid (ties: the smaller), and the squared distance."""
    c = np.array(centroids, dtype=object).reshape(len(centroids), -1)
    most = max(max((abs(int(v)) for v in (x.min(), x.max())), default=0) if x.size else 0, max((abs(v) for row in centroids for v in row), default=0))
    if 4 * most * most * max(1, x.shape[1]) < 1 << 53:  # doubles hold all sums exactly
        a, b = x.astype(np.float64), c.astype(np.float64)
        d = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    else:
        kind = np.int64 if 4 * most * most * max(1, x.shape[1]) <= _LONG else object
        d = np.stack([((x.astype(kind) - row[None, :].astype(kind)) ** 2).sum(axis=1) for row in c], axis=1)
    best = d.argmin(axis=1) if len(d) else np.zeros(0, np.int64)
    found = d[np.arange(len(d)), best]
    return best.astype(np.int32), np.array([min(int(v), _LONG) for v in found], np.int64) if d.dtype == object else found.astype(np.int64)


def _exact(products: np.ndarray, n: np.ndarray) -> bool:
    """True if sums of multiplicity times component stay within 62 bits."""
    return not products.size or max(abs(int(products.min())), abs(int(products.max()))) * int(n.sum()) < 1 << 62


def sums(distinct: DataFrame, centroids: list[list[int]]) -> list[tuple[int, int, list[int]]]:
    """Number, rows and componentwise sum of every non-empty cluster; one row a cluster comes to the driver."""
    dims = len(centroids[0])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), object)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x, n = unpack(part.column("vector").to_pylist(), dims), part.column("n").to_numpy()
                best, _ = nearest(x, centroids)
                whole = _exact(x, n)
                for c in np.unique(best).tolist():
                    own = best == c
                    rows[c] += n[own].sum()
                    total[c] += (x[own] * n[own, None]).sum(axis=0) if whole else (x[own].astype(object) * n[own, None].astype(object)).sum(axis=0)
        full = np.flatnonzero(rows)
        halves = [[[int(v) >> 32 for v in total[c]], [int(v) & 0xFFFFFFFF for v in total[c]]] for c in full]
        cells = [pa.array([h[k] for h in halves], pa.list_(pa.int64())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(rows[full]), *cells], names=["cluster", "n", "high", "low"])

    each = distinct.mapInArrow(totals, "cluster int, n long, high array<long>, low array<long>")
    added = [F.sum(F.col(half)[i]).alias(f"{half}{i}") for half in ("high", "low") for i in range(dims)]
    found = each.groupBy("cluster").agg(F.sum("n").alias("n"), *added).collect()  # one row a cluster
    return [(r["cluster"], r["n"], [(r[f"high{i}"] << 32) + r[f"low{i}"] for i in range(dims)]) for r in found]


def assigned(distinct: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The distinct vectors with cluster and distance."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                best, distance = nearest(unpack(part.column("vector").to_pylist(), len(centroids[0])), centroids)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best), pa.array(distance)], names=["vector", "n", "cluster", "distance"])

    return distinct.mapInArrow(rows, "vector binary, n long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int, rounds: int, dims: int = 64, factor: int = 256, salt: str = "2:", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Columns vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector that takes part.

    Centroids start as the k vectors whose ids, as decimals behind ``salt``, have the least SHA-256.
    """
    spark = vectors.sparkSession
    kept = materialise(quantised(vectors, dims, factor, vec_id, vector), "quantised")
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.orderBy(order.asc_nulls_last(), "vec_id", "vector").limit(k).select("vector").collect()  # k rows
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = unpack([bytes(r["vector"]) for r in first], dims).tolist()
    distinct = materialise(kept.groupBy("vector").agg(F.count(F.lit(1)).alias("n")), "distinct")
    for _ in range(rounds):
        for c, n, total in sums(distinct, centroids):
            centroids[c] = [s // n for s in total]
    found = materialise(assigned(distinct, centroids), "assigned")
    discard(distinct)
    spread = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(19,0)") * F.col("distance").cast("decimal(19,0)")).alias("d"), F.count(F.lit(1))).collect()}  # k rows
    whole, rows = sum(spread.values()), kept.count()
    facts = [(c, min(d, _LONG), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, d in sorted(spread.items())]
    facts = F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, centroid_sha256 string"))  # k rows
    often = F.col("n") * FREQUENT > rows
    frequent = F.broadcast(found.where(often).select("vector", "cluster", "distance"))  # fewer than FREQUENT rows
    rare = kept.join(frequent.select("vector"), "vector", "left_anti").join(found.where(~often).select("vector", "cluster", "distance"), "vector")
    out = kept.join(frequent, "vector").select("vec_id", "cluster", "distance").union(rare.select("vec_id", "cluster", "distance"))
    return out.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(min(whole, _LONG)).alias("inertia"), "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """The query for DuckDB: every vector by itself, one step a round."""
    step = """
a{0} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT v.r, c{0}.c, CAST(list_sum(list_transform(list_zip(v.x, c{0}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{0}) GROUP BY r),"""
    move = """
c{1} AS MATERIALIZED (SELECT c{0}.c, coalesce(m.x, c{0}.x) AS x FROM c{0} LEFT JOIN (
  SELECT c, list(CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END ORDER BY i) AS x FROM (
    SELECT c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{0} JOIN v USING (r), range(1, {2}) t(i) GROUP BY c, i) GROUP BY c) m USING (c)),"""
    parts = [
        f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, vec_id) - 1 AS c, x FROM (SELECT vec_id, x, sha256('2:' || vec_id) AS h FROM v ORDER BY h, vec_id LIMIT {k})),"""
    ]
    for i in range(rounds):
        parts += [step.format(i), move.format(i, i + 1, dims + 1)]
    parts += [
        step.format(rounds),
        f"""
t AS (SELECT c, sum(d)::BIGINT AS total FROM a{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, total AS cluster_inertia, (SELECT sum(total)::BIGINT FROM t) AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN t USING (c) JOIN c{rounds} USING (c)
""",
    ]
    return "".join(parts)


SQL = _sql()
