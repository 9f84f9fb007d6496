"""Connected components of edge tables, by contraction.

In each round every node joins the neighbour (or itself) of least rank, ranks being drawn anew by a hash of node and
round, and edges move to the nodes that were joined. A constant share of the nodes vanishes in expected terms, whatever
the shape of the graph; a hub's neighbours are reduced to their minimum before the shuffle. Before the first round each
task keeps only a spanning forest of its own edges. When at most ``FINISH`` edges are left, one task finishes them.
Rounds are written to the shared folder, so a lost executor costs one round at most and lineage stays short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.session import materialise

#: Edges that one task may finish (16 bytes each, and as much again for the nodes).
FINISH = 100_000


class Forest:
    """Union-find over integers or strings; the root of a set is its least member."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up, path = self.up, []
        while (y := up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            up[p] = x
        return x

    def join(self, a, b) -> bool:
        """True if the two were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each few batches, edges that span the same sets."""
    for batch in batches:
        forest = Forest()
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        keep = np.array([forest.join(x, y) for x, y in zip(a, b, strict=True)], bool)
        yield batch.filter(pa.array(keep))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    nodes: set = set()
    for batch in batches:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            forest.join(x, y)
            nodes.update((x, y))
        kind = batch.schema.field("a").type
    if nodes:
        listed = sorted(nodes)
        yield pa.RecordBatch.from_pydict({"node": pa.array(listed, kind), "to": pa.array([forest.root(x) for x in listed], kind)})


def components(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """Columns node, component (its set's least node) for every node of the edges (columns a, b of one type, long or
    string; no nulls).

    Loops and repeated edges do no harm; without edges the result is empty.
    """
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType.simpleString()
    rest = materialise(edges.select("a", "b").where("a <> b").mapInArrow(_forest, f"a {kind}, b {kind}"), "edges")
    moved: DataFrame | None = None  # node -> the node that now stands for it
    for k in range(200):
        left = rest.count()
        if left <= finish:
            break
        both = rest.union(rest.select("b", "a"))
        rank = F.xxhash64("to", F.lit(k))
        step = both.select(F.col("a").alias("node"), F.col("b").alias("to")).union(both.select("a", "a")).groupBy("node").agg(F.min_by("to", F.struct(rank, "to")).alias("to"))
        step = materialise(step, f"step-{k}")
        ends = rest.join(step, rest["a"] == step["node"]).select(F.col("to").alias("a"), "b")
        ends = ends.join(step, ends["b"] == step["node"]).select("a", F.col("to").alias("b")).where("a <> b")
        rest = materialise(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"edges-{k}")
        moved = step if moved is None else materialise(_then(moved, step), f"moved-{k}")
    last = rest.repartition(1).mapInArrow(_finish, f"node {kind}, to {kind}") if left else spark.createDataFrame([], f"node {kind}, to {kind}")
    if moved is None:
        return last.select("node", F.col("to").alias("component"))
    roots = _then(moved, last)
    least = roots.groupBy("to").agg(F.min("node").alias("component"))
    return roots.join(least, "to").select("node", "component")


def _then(moved: DataFrame, step: DataFrame) -> DataFrame:
    """First one mapping, then the other where it has the node."""
    step = step.select(F.col("node").alias("via"), F.col("to").alias("next"))
    return moved.join(step, moved["to"] == step["via"], "left").select("node", F.coalesce("next", "to").alias("to"))
