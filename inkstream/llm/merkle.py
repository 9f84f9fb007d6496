"""Operator 13: Merkle manifest of a table, by traversal of its trees.

Every row is a leaf: the SHA-256 of its fields. A group's leaves (here a language's), ordered by id, form a binary tree; the
groups' roots, ordered by group, form another one on top. In a tree, every two consecutive nodes become one, and a last
node without partner is hashed alone, while there are several.

Places in the order come from a range partitioned sort: each partition knows how many rows of a group stand before it.
Trees are cut into aligned blocks of ``BLOCK`` leaves. A first pass gives each block's root, by a treehash stack; the roots
are the leaves of the next tier, and so on up to the group's root; a last tree joins the groups. Then paths go down:
a block takes the path of its own root, which its leaves share, and a traversal runs through the block. It holds the path of
the current leaf and a treehash stack a level, so its memory is logarithmic in the block; after each leaf, levels whose
node changes take their stack's result and begin another stack, and two steps a level are dealt to the stacks. No task
holds more than a block, no text is shuffled, and a group of any share of the rows is many blocks.

Results: one row for each row. Rows without id stand first and are not tampered with; rows of one id go by leaf, so that
repeated rows are leaves of equal hash. A null group is a group, the first one; empty texts are values. An empty table
gives no rows. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from inkstream.llm import columns
from inkstream.session import discard, materialise, partitions

#: Leaves in an aligned block, as a power of two.
BLOCK_BITS = 9


def hashed(*digests: str) -> str:
    """SHA-256 of the concatenated digests' hex text, as hex text."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """SHA-256 of the fields, each as its number of UTF-8 bytes, a colon and the value, or as ``-`` if it is null."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


class Treehash:
    """A stack that works out one node from its leaves, a leaf or a merger a step.

    The node stands at ``level`` above the leaves ``first`` and following; beyond the block's end there are none, and a
    node that has one child only is that one's hash.
    """

    def __init__(self, leaves: list[str], first: int, level: int):
        self.leaves, self.at, self.level = leaves, first, level
        self.end = min(len(leaves), first + (1 << level))
        self.stack: list[tuple[int, str]] = []

    def step(self) -> bool:
        """One unit of work; False if there is none left."""
        stack = self.stack
        if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            (height, right), (_, left) = stack.pop(), stack.pop()
            stack.append((height + 1, hashed(left, right)))
        elif self.at < self.end:
            stack.append((0, self.leaves[self.at]))
            self.at += 1
        elif stack and (len(stack) > 1 or stack[0][0] < self.level):  # the block ended: the last node goes up alone
            height, node = stack.pop()
            stack.append((height + 1, hashed(node)))
        else:
            return False
        return True

    def result(self) -> str | None:
        """The node, or None if it has no leaves."""
        while self.step():
            pass
        return self.stack[0][1] if self.stack else None


def block_root(leaves: list[str], levels: int) -> str:
    """The node ``levels`` above a block's leaves."""
    return Treehash(leaves, 0, levels).result()


def traversal(leaves: list[str], levels: int) -> Iterator[list[str | None]]:
    """For each leaf, one after the other, its siblings from the lowest level up (None where it has none)."""
    path = [Treehash(leaves, 1 << h, h).result() for h in range(levels)]
    stacks = [Treehash(leaves, 0, h) for h in range(levels)]  # what the path of a level becomes next
    for i in range(len(leaves)):
        yield path
        for h in range(levels):
            if (i + 1) % (1 << h):
                break
            path[h] = stacks[h].result()
            stacks[h] = Treehash(leaves, ((i + 1 + (1 << h)) ^ (1 << h)), h)
        work = 2 * levels
        for stack in stacks:
            while work and stack.step():
                work -= 1


def depth(n: int) -> int:
    """Levels of a tree with n leaves."""
    return max(0, n - 1).bit_length()


def fold(node: str, place: int, path: list[str]) -> str:
    """The root that follows from a leaf at this place and its siblings by level (empty: it has none)."""
    for other in path:
        node = hashed(node) if not other else hashed(node, other) if place % 2 == 0 else hashed(other, node)
        place >>= 1
    return node


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows``, written in order, with ``place`` (from 0) within their group ``g`` and the group's ``size``.

    Nulls come first. Each partition counts its own rows of a group; the rows before it are a sum over these counts, one
    for each partition and group. Rows that are equal throughout are told apart by ``salt``, so that they can be split.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("g", *order, "salt")]
    salted = materialise(rows.withColumn("salt", F.monotonically_increasing_id()), "leaves")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, n = None, 0
        for batch in batches:
            within = []
            for g in batch.column("g").to_pylist():
                group, n = g, n + 1 if g == group else 0
                within.append(n)
            yield batch.append_column("within", pa.array(within, pa.int64()))

    dealt = salted.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()).drop("salt")
    dealt = materialise(dealt.mapInArrow(count, StructType([*dealt.schema.fields, StructField("within", LongType())])), "ordered")
    discard(salted)
    counts = dealt.groupBy("part", "g").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("g")
    before = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = materialise(counts.select("part", "g", before.alias("before"), F.sum("n").over(group).alias("size")), "counts")
    return dealt.join(counts, ["part", "g"]).withColumn("place", F.col("before") + F.col("within")).drop("part", "before", "within")


def _tiers(nodes: DataFrame, bits: int) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of all groups' trees, from the leaves up, and the groups' roots.

    Columns g, place, size (of the group in this tier), node. A block's root is a node of the next tier; a group that fits
    a block ends with its own depth, others go ``bits`` levels up in each tier.
    """

    def root(key: tuple, table: pa.Table) -> pa.Table:
        size, table = table.column("size")[0].as_py(), table.sort_by("place")
        found = block_root(table.column("node").to_pylist(), min(bits, depth(size)))
        return pa.table({"g": pa.array([key[0].as_py()], pa.string()), "place": pa.array([key[1].as_py()], pa.int64()), "size": pa.array([-(-size >> bits)], pa.int64()), "node": pa.array([found])})

    tiers = [nodes]
    while True:
        blocks = tiers[-1].select("g", F.expr(f"shiftright(place, {bits})").alias("block"), "place", "size", "node")
        up = materialise(blocks.groupBy("g", "block").applyInArrow(root, "g string, place long, size long, node string"), "tier")
        if up.where("size > 1").isEmpty():
            return tiers, up
        tiers.append(up)


#: What is known above a node: siblings' hex by level, each followed by a comma; the group's root and its place among groups.
ABOVE = "g string, place long, path string, subroot string, spot long"


def _descend(tier: DataFrame, above: DataFrame, bits: int, make: Callable[[pa.Table, list[str], dict], dict], schema: str) -> DataFrame:
    """Rows that ``make`` gives for each block: from its rows in order, the path of each to the top, and what is known
    above its root (``above`` has a row a block)."""

    def block(key: tuple, table: pa.Table, upper: pa.Table) -> pa.Table:
        table, known = table.sort_by("place"), upper.to_pylist()[0]
        size, nodes = table.column("size")[0].as_py(), table.column("node").to_pylist()
        paths = ["".join((x or "") + "," for x in own) + known["path"] for own in traversal(nodes, min(bits, depth(size)))]
        return pa.table(make(table, paths, known))

    rows = tier.withColumn("block", F.expr(f"shiftright(place, {bits})"))
    upper = above.withColumnRenamed("place", "block")
    return rows.groupBy("g", "block").cogroup(upper.groupBy("g", "block")).applyInArrow(block, schema)


def _down(tiers: list[DataFrame], above: DataFrame, bits: int) -> DataFrame:
    """What is known above every block of the lowest tier, from what is known above each group's root."""

    def paths(table: pa.Table, paths: list[str], known: dict) -> dict:
        n = len(paths)
        return {"g": table.column("g"), "place": table.column("place"), "path": pa.array(paths, pa.string()), "subroot": pa.array([known["subroot"]] * n, pa.string()), "spot": pa.array([known["spot"]] * n, pa.int64())}

    for tier in reversed(tiers[1:]):
        above = materialise(_descend(tier, above, bits, paths, ABOVE), "paths")
    return above


def manifest(docs: DataFrame, fields: tuple[str, ...], group: str = "lang", key: str = "doc_id", tampered: Column | None = None, changed: dict[str, Column] | None = None, proofs: bool = True, bits: int = BLOCK_BITS) -> DataFrame:
    """Columns doc_id (the key, an integer), leaf, subroot, root, proof_sha256 (of the siblings' hex, up to the root),
    folded_root and verified; with ``proofs`` also proof, the siblings by level (empty where a node has none).

    ``folded_root`` follows from the siblings and the leaf, or, where ``tampered`` holds, the leaf of the row with its
    ``changed`` columns.
    """
    plain = columns.plain(docs, *dict.fromkeys((key, group, *fields)))
    own, other = leaf(*[F.col(c) for c in fields]), leaf(*[(changed or {}).get(c, F.col(c)) for c in fields])
    told = F.when(F.lit(False) if tampered is None else tampered, other)
    g = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))  # the null group is first
    rows = ranked(plain.select(g.alias("g"), F.col(key).cast("long").alias("doc_id"), own.alias("node"), told.alias("told")), ["doc_id", "node"])
    tiers, roots = _tiers(rows, bits)

    heads = ranked(roots.select(F.lit("").alias("g"), F.col("g").alias("own"), "node"), ["own"])  # the tree of the groups
    tops, top = _tiers(heads, bits)
    over = _down(tops, top.select("g", "place", F.lit("").alias("path"), F.lit("").alias("subroot"), F.lit(0).cast("long").alias("spot")), bits)

    def group_path(table: pa.Table, paths: list[str], known: dict) -> dict:
        return {"g": table.column("own"), "place": pa.array([0] * len(paths), pa.int64()), "path": pa.array(paths, pa.string()), "subroot": table.column("node"), "spot": table.column("place")}

    above = _down(tiers, materialise(_descend(heads, over, bits, group_path, ABOVE), "groups"), bits)
    first = top.select("node").first()
    root = first["node"] if first else ""

    def leaves(table: pa.Table, paths: list[str], known: dict) -> dict:
        height, spot = depth(table.column("size")[0].as_py()), known["spot"]
        listed = [p[:-1].split(",") if p else [] for p in paths]
        nodes, places = table.column("node").to_pylist(), table.column("place").to_pylist()
        start = [n if t is None else t for n, t in zip(nodes, table.column("told").to_pylist(), strict=True)]
        folded = [fold(n, place | spot << height, path) for n, place, path in zip(start, places, listed, strict=True)]
        out = {"doc_id": table.column("doc_id"), "leaf": table.column("node"), "subroot": pa.array([known["subroot"]] * len(paths)), "proof_sha256": pa.array([hashed(*path) for path in listed]), "folded_root": pa.array(folded)}
        return out | ({"proof": pa.array(listed, pa.list_(pa.string()))} if proofs else {})

    schema = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string" + ", proof array<string>" * proofs
    found = _descend(rows, above, bits, leaves, schema)
    return found.withColumns({"root": F.lit(root), "verified": F.col("folded_root") == root})


#: The query for DuckDB: levels of all trees by recursion; crc32 bit by bit.
SQL = r"""
WITH RECURSIVE d AS (SELECT *, coalesce((xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda v, z: xor(v >> 1, 3988292384::UBIGINT * (v & 1)))))) % 7 = 0, false) AS hit FROM documents),
f AS (SELECT doc_id, lang, hit, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a, coalesce(strlen(text) || ':' || text, '-') AS z FROM d),
l AS (SELECT doc_id, lang, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS leaf,
  sha256(a || coalesce(strlen((n_chars::HUGEINT + hit::INT)::VARCHAR) || ':' || (n_chars::HUGEINT + hit::INT), '-') || z) AS told FROM f),
p AS MATERIALIZED (SELECT row_number() OVER () AS r, *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS size FROM l),
t AS (SELECT lang, 0 AS level, place, size, leaf AS node FROM p
  UNION ALL SELECT lang, level + 1, place // 2, (size + 1) // 2, sha256(string_agg(node, '' ORDER BY place)) FROM t WHERE size > 1 GROUP BY lang, level, place // 2, size),
s AS MATERIALIZED (SELECT lang, node AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS spot, count(*) OVER () AS size FROM t WHERE size = 1),
u AS (SELECT 0 AS level, spot AS place, size, subroot AS node FROM s
  UNION ALL SELECT level + 1, place // 2, (size + 1) // 2, sha256(string_agg(node, '' ORDER BY place)) FROM u WHERE size > 1 GROUP BY level, place // 2, size),
b AS (SELECT p.r, e.level, (p.place >> e.level) % 2 AS side, t.node FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN range(0, 64) e(level) ON e.level < s.height
    LEFT JOIN t ON t.lang IS NOT DISTINCT FROM p.lang AND t.level = e.level AND t.place = xor(p.place >> e.level, 1)
  UNION ALL SELECT p.r, s.height + e.level, (s.spot >> e.level) % 2, u.node FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang JOIN range(0, 64) e(level) ON e.level < (SELECT max(level) FROM u)
    LEFT JOIN u ON u.level = e.level AND u.place = xor(s.spot >> e.level, 1)),
w AS (SELECT r, coalesce(string_agg(node, '' ORDER BY level), '') AS proof, list(CASE WHEN node IS NULL THEN '-' WHEN side = 0 THEN 'r' || node ELSE 'l' || node END ORDER BY level) AS path FROM b GROUP BY r),
q AS (SELECT doc_id, leaf, subroot, (SELECT node FROM u WHERE size = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
  list_reduce([told] || coalesce(path, []), lambda x, y: sha256(CASE y[1] WHEN '-' THEN x WHEN 'r' THEN x || y[2:] ELSE y[2:] || x END)) AS folded_root
  FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang LEFT JOIN w USING (r))
SELECT *, folded_root = root AS verified FROM q
"""
