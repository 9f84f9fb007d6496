"""Incremental state (T01-T03): upserts by key into buckets that split as the table grows, stages that know their inputs'
content, and resumption by ranges. Batch tables and Structured Streaming."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from inkstream.operators.rows import first_wins, folded, upsert
from inkstream.session import discard, materialise
from inkstream.sources.sinks import exists, listed, remove

#: Low bits of a key's hash that a new table's buckets go by; rows in a bucket, at most about.
START_DEPTH, CAPACITY = 6, 1_000_000
_VERSION = "depth int, prefix long, folder string, rows long, stream string, batch long"

Bucket = tuple[int, int]


def _whole(full: dict[Bucket, tuple[str | None, int]]) -> dict[Bucket, tuple[str | None, int]]:
    """The buckets of all keys, of which only those with rows are stored: what these leave out are empty buckets."""
    inner = {(d, p & ((1 << d) - 1)) for depth, p in full for d in range(depth)}
    out, open_ = dict(full), [(0, 0)]
    while open_:
        depth, prefix = bucket = open_.pop()
        if bucket in inner or depth < START_DEPTH and bucket not in full:
            open_ += [(depth + 1, prefix), (depth + 1, prefix | 1 << depth)]
        else:
            out.setdefault(bucket, (None, 0))
    return out


@dataclass
class Directory:
    """One version of a table: its buckets' folders and sizes, and the last micro-batch of each stream.

    A bucket (depth, prefix) holds the keys whose hash ends in these bits: an extendible hash directory, in which a bucket
    that grows too large gives way to deeper ones and the others stay.
    """

    number: int = 0
    buckets: dict[Bucket, tuple[str | None, int]] = field(default_factory=lambda: _whole({}))
    streams: dict[str, int] = field(default_factory=dict)

    @property
    def folders(self) -> list[str]:
        return sorted(f for f, _ in self.buckets.values() if f)


def _complete(spark: SparkSession, path: str, n: int) -> bool:
    return exists(spark, f"{path}/versions/v{n}/_SUCCESS")


def directory(spark: SparkSession, path: str, number: int | None = None) -> Directory:
    """The newest complete version, or the one of this number if it is there; the driver holds one row a bucket."""
    done = [int(name[1:]) for name in listed(spark, f"{path}/versions")] if number is None else [number]
    done = sorted((n for n in done if n > 0 and _complete(spark, path, n)), reverse=True)[:1]
    if not done:
        return Directory(buckets={}) if number is not None else Directory()
    rows = spark.read.schema(_VERSION).parquet(f"{path}/versions/v{done[0]}").collect()
    buckets = {(r["depth"], r["prefix"]): (r["folder"], r["rows"]) for r in rows if r["stream"] is None}
    return Directory(done[0], _whole(buckets), {r["stream"]: r["batch"] for r in rows if r["stream"] is not None})


def _read(spark: SparkSession, schema: str | StructType, folders: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def versioned(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, int]:
    """The newest complete version of a table below ``path``, and its number (0: none yet)."""
    now = directory(spark, path)
    return _read(spark, schema, now.folders), now.number


def _placed(rows: DataFrame, key: str, buckets: Iterable[Bucket]) -> DataFrame:
    """Rows with the bucket (depth, prefix) of those given that their key falls into; others drop out."""
    buckets = sorted(buckets)
    depths = F.array(*[F.lit(d) for d in sorted({d for d, _ in buckets})])
    leaves = rows.sparkSession.createDataFrame(buckets, "depth int, prefix long")
    each = rows.withColumn("depth", F.explode(depths))
    prefix = F.xxhash64(key).bitwiseAND(F.expr("shiftleft(1L, depth) - 1L"))
    return each.withColumn("prefix", prefix).join(leaves, ["depth", "prefix"])


def _targets(bucket: Bucket, rows: int, capacity: int) -> list[Bucket]:
    """What a bucket becomes that is to hold so many rows at most: itself, or deeper ones that together are it."""
    depth, prefix = bucket
    more = max(0, math.ceil(math.log2(max(rows, 1) / capacity)))
    return [(depth + more, prefix | i << depth) for i in range(1 << more)]


def apply_batch(
    new: DataFrame, path: str, schema: str, key: str = "url", filled: tuple[str, ...] = ("snippet",), stream: str | None = None, batch: int = 0, fold: bool = False, capacity: int | None = None
) -> dict[str, int]:
    """One batch merged into the table as its next version; counts of added, updated and kept rows of the buckets
    that it touches.

    Only buckets with keys of the batch are read and written, and a bucket holds about ``capacity`` rows at most, so what
    a batch rewrites is bounded by what it touches, however large the table is. A version is a small table of the buckets'
    folders; the version before stays whole until the next one is complete, so a batch that fails leaves nothing half
    done. With ``stream`` the number of the batch is part of the version: one that is not above the stream's last changes
    nothing, so a batch that is replayed is merged once. A batch's first row of a key counts; with ``fold`` its later ones
    fill what that leaves empty, as if each were a batch. Two writers at a time meet at the version's folder, and one fails.
    """
    spark, capacity = new.sparkSession, capacity or CAPACITY
    now = directory(spark, path)
    if stream is not None and batch <= now.streams.get(stream, -1):
        return {}
    new = materialise(folded(new, [key], ["pos"], list(filled)) if fold else first_wins(new, [key], ["pos"]), "batch")
    sizes = {(r["depth"], r["prefix"]): r["n"] for r in _placed(new.select(key), key, now.buckets).groupBy("depth", "prefix").agg(F.count(F.lit(1)).alias("n")).collect()}
    known = _read(spark, schema, [f for b in sizes if (f := now.buckets[b][0])])
    targets = [t for b, n in sizes.items() for t in _targets(b, now.buckets[b][1] + n, capacity)]
    counts: dict[str, int] = {}
    buckets = {b: x for b, x in now.buckets.items() if b not in sizes} | {t: (None, 0) for t in targets}
    if targets:
        data = f"{path}/data/{uuid.uuid4().hex}"
        _placed(upsert(known, new, key, list(filled)), key, targets).repartition("depth", "prefix").write.partitionBy("depth", "prefix").parquet(data)
        for r in spark.read.parquet(data).groupBy("depth", "prefix", "action").count().collect():
            b = (r["depth"], r["prefix"])
            buckets[b] = (f"{data}/depth={b[0]}/prefix={b[1]}", buckets[b][1] + r["count"])
            counts[r["action"]] = counts.get(r["action"], 0) + r["count"]
    streams = now.streams | ({stream: batch} if stream is not None else {})
    rows = [(*b, f, n, None, None) for b, (f, n) in sorted(buckets.items()) if f] + [(None, None, None, None, s, b) for s, b in streams.items()]
    version = f"{path}/versions/v{now.number + 1}"
    if exists(spark, version):  # left by a batch that failed
        remove(spark, [version])
    spark.createDataFrame(rows, _VERSION).coalesce(1).write.mode("error").parquet(version)
    discard(new)
    kept = {*now.folders, *(f for f, _ in buckets.values())}
    remove(spark, [f for f in directory(spark, path, now.number - 1).folders if f not in kept])
    return counts


def upsert_stream(stream: DataFrame, path: str, schema: str, checkpoint: str, name: str = "upserts", **options):
    """T01 as a stream: every micro-batch is merged by ``apply_batch`` and fenced by its number under the stream's name. Rows
    of one key fill each other within a micro-batch as they do across two, so it does not matter where the stream is cut."""

    def merge(rows: DataFrame, number: int) -> None:
        apply_batch(rows, path, schema, stream=name, batch=number, fold=True, **options)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()


def fingerprint(df: DataFrame) -> str:
    """A hash of a table's rows, whatever their order and how they are dealt; repeated rows count each.

    Two sums of 64-bit row hashes with different seeds, in decimals that no number of rows overflows, and the number of
    rows and the columns. Nulls are told from each other by their place.
    """
    hashable = [F.sort_array(F.map_entries(c)) if isinstance(f.dataType, MapType) else F.col(c) for c, f in ((f"`{f.name}`", f) for f in df.schema)]
    marks = [x for c in hashable for x in (c.isNull(), c)]
    sums = [F.sum(F.xxhash64(F.lit(seed), *marks).cast("decimal(38,0)")) for seed in (1, 2)]
    found = df.agg(F.count(F.lit(1)), *sums).first()
    return hashlib.sha256(repr((df.schema.simpleString(), *map(str, found))).encode()).hexdigest()


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], inputs: Iterable[DataFrame] | None = None, version: str = "") -> DataFrame:
    """A stage's table, built only if it is not there complete; with ``inputs``, complete for their content.

    The table stands under the fingerprint of its inputs and the builder's ``version``, so it is found again while they
    are the same, whoever asks; once a new one is complete, older ones are removed.
    """
    if inputs is None:
        own = path
    else:
        mark = hashlib.sha256("\n".join([version, *map(fingerprint, inputs)]).encode()).hexdigest()[:32]
        own = f"{path}/content={mark}"
    if not exists(spark, f"{own}/_SUCCESS"):
        build().write.mode("overwrite").parquet(own)
        if inputs is not None:
            remove(spark, [f"{path}/{name}" for name in listed(spark, path) if name.startswith("content=") and f"{path}/{name}" != own])
    return spark.read.parquet(own)


def remaining(work: DataFrame, done: DataFrame, key: str = "hash") -> DataFrame:
    """What a resumed run still has to do."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def by_ranges(work: DataFrame, path: str, do: Callable[[DataFrame], DataFrame], key: str = "hash", ranges: int = 16, range_of: Column | None = None) -> DataFrame:
    """``do`` over the work, a range of the key's hash at a time, each committed by itself below ``path``.

    The work is dealt to ranges once; a run that comes after one that was stopped takes the ranges as they were dealt and
    does only those that are not complete, so a stop loses one range at most. The result reads the ranges' folders;
    ``finish`` writes it elsewhere and removes the ledger.
    """
    spark = work.sparkSession
    todo = f"{path}/work"
    if not exists(spark, f"{todo}/_SUCCESS"):
        place = F.pmod(F.xxhash64(key), F.lit(ranges)) if range_of is None else range_of
        work.withColumn("range", place.cast("int")).repartition("range", F.xxhash64(key) % 32).write.mode("overwrite").partitionBy("range").parquet(todo)
    for k in range(ranges):
        own, rows = f"{path}/done/part-{k}", f"{todo}/range={k}"
        if not exists(spark, f"{own}/_SUCCESS"):
            do(_read(spark, work.schema, [rows] if exists(spark, rows) else [])).write.mode("overwrite").parquet(own)
    return spark.read.parquet(*[f"{path}/done/part-{k}" for k in range(ranges)])


def finish(result: DataFrame, path: str, target: str) -> DataFrame:
    """Write what ``by_ranges`` gave as one table and remove its ledger."""
    spark = result.sparkSession
    result.write.mode("overwrite").parquet(target)
    remove(spark, [path])
    return spark.read.parquet(target)
