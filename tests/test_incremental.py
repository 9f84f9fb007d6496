"""Upserts into buckets that split, fenced micro-batches, stages that know their inputs, resumption by ranges."""

import random

import pytest
from pyspark.sql import functions as F

from inkstream.sources.sinks import listed
from inkstream.streaming import incremental

SCHEMA = "url string, snippet string, action string"


def batch(spark, rows):
    return spark.createDataFrame([(u, s, i) for i, (u, s) in enumerate(rows)], "url string, snippet string, pos int")


def test_buckets_split_as_the_table_grows(spark, tmp_path, monkeypatch):
    """Random batches against a dictionary; no bucket grows far beyond its capacity, and none that a batch does not touch
    is written again."""
    monkeypatch.setattr(incremental, "START_DEPTH", 1)
    rng, path, table = random.Random(1), str(tmp_path / "t"), {}
    for n in (3, 40, 150, 60):
        rows = [(f"u{rng.randint(0, 400)}", rng.choice(("", None, f"s{i}"))) for i in range(n)]
        before = incremental.directory(spark, path).buckets
        incremental.apply_batch(batch(spark, rows), path, SCHEMA, capacity=16)
        first = {}
        for u, s in rows:
            first.setdefault(u, s)
        for u, s in first.items():
            table[u] = table.get(u) or s or None
        got = {r["url"]: r["snippet"] or None for r in incremental.versioned(spark, path, SCHEMA)[0].collect()}
        assert got == table
        after = incremental.directory(spark, path).buckets
        assert sum(n for _, n in after.values()) == len(table) and all(n <= 40 for _, n in after.values())
        whole = sum(1 / (1 << d) for d, _ in after)
        assert whole == 1  # the buckets are all keys, each once
    touched = incremental._placed(batch(spark, [("u1", "x")]).select("url"), "url", after).first()
    incremental.apply_batch(batch(spark, [("u1", "x")]), path, SCHEMA, capacity=16)
    now = incremental.directory(spark, path).buckets
    assert len(before) < len(after) and {b for b in after if now.get(b) != after[b]} == {(touched["depth"], touched["prefix"])}
    assert len(listed(spark, f"{path}/versions")) == 5


def test_replayed_batches_change_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = batch(spark, [("a", "1"), ("b", None)]), batch(spark, [("b", "2"), ("c", "3")])
    assert incremental.apply_batch(one, path, SCHEMA, stream="s", batch=0) == {"added": 2}
    incremental.apply_batch(two, path, SCHEMA, stream="s", batch=1)
    before = incremental.directory(spark, path)
    assert incremental.apply_batch(one, path, SCHEMA, stream="s", batch=0) == {} == incremental.apply_batch(two, path, SCHEMA, stream="s", batch=1)
    assert incremental.directory(spark, path) == before and before.streams == {"s": 1}
    incremental.apply_batch(batch(spark, []), path, SCHEMA, stream="other", batch=5)
    assert incremental.directory(spark, path).streams == {"s": 1, "other": 5} and incremental.versioned(spark, path, SCHEMA)[0].count() == 3


def test_a_stream_may_be_cut_anywhere(spark, tmp_path):
    """A row and the one that fills it give the same table from one micro-batch, in either order, or from several."""
    kind = "url string, snippet string, pos long"
    generations = [("a", "", 0), ("a", "1", 0), ("b", None, 1), ("b", "2", 2), ("b", "3", 3), ("c", "4", 5), ("c", "5", 6), ("d", "", 7)]
    for name, files in {"one": [generations], "back": [generations[::-1]], "each": [[x] for x in generations]}.items():
        source = str(tmp_path / name / "in")
        for rows in files:
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
        incremental.upsert_stream(stream, str(tmp_path / name / "t"), SCHEMA, str(tmp_path / name / "offsets")).awaitTermination()
        got = {r["url"]: r["snippet"] or None for r in incremental.versioned(spark, str(tmp_path / name / "t"), SCHEMA)[0].collect()}
        assert got == {"a": "1", "b": "2", "c": "4", "d": None}, name


def test_a_failed_batch_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "t")
    incremental.apply_batch(batch(spark, [("a", "1")]), path, SCHEMA)
    broken = batch(spark, [("a", "1"), ("b", "2")]).withColumn("snippet", F.when(F.col("url") == "b", F.raise_error(F.lit("no"))).otherwise(F.col("snippet")))
    with pytest.raises(Exception, match="no"):
        incremental.apply_batch(broken, path, SCHEMA)
    spark.range(1).write.parquet(f"{path}/versions/v2/part")  # and one that was stopped while it was written
    assert incremental.versioned(spark, path, SCHEMA)[1] == 1
    assert incremental.apply_batch(batch(spark, [("b", "2")]), path, SCHEMA) == {"added": 1}
    assert sorted(r["url"] for r in incremental.versioned(spark, path, SCHEMA)[0].collect()) == ["a", "b"]


def test_fingerprints(spark):
    rows = [(1, "a", None, {"k": 1, "l": 2}), (2, None, "a", {}), (2, None, "a", {}), (None, "", "b", None)]
    kind = "i int, a string, b string, m map<string, int>"
    mark = lambda r, k=kind: incremental.fingerprint(spark.createDataFrame(r, k))
    same = mark(rows)
    assert mark(rows[::-1]) == same == incremental.fingerprint(spark.createDataFrame(rows, kind).repartition(3, "a"))
    others = [rows[:3], rows + rows[:1], [(1, None, "a", {"k": 1, "l": 2}), *rows[1:]], [(1, "a", None, {"k": 2, "l": 1}), *rows[1:]], [*rows[:3], (None, None, "b", None)], []]
    assert len({same, *map(mark, others), mark(rows, kind.replace("i int", "i long"))}) == len(others) + 2


def test_stages_know_their_inputs(spark, tmp_path):
    made, path = [], str(tmp_path / "s")
    get = lambda rows, version="": incremental.stage(spark, path, lambda: made.append(len(rows)) or spark.createDataFrame([(len(rows),)], "n int"), [spark.createDataFrame(rows, "a int")], version).first()["n"]
    assert [get([(1,), (2,)]), get([(2,), (1,)]), get([(1,)]), get([(1,)]), get([(1,)], "v2")] == [2, 2, 1, 1, 1]
    assert made == [2, 1, 1] and len(listed(spark, path)) == 1


def test_a_stopped_run_loses_one_range(spark, tmp_path):
    path, seen = str(tmp_path / "l"), []
    work = spark.range(200).select(F.col("id").alias("hash"))

    def do(rows):
        ids = [r["hash"] for r in rows.collect()]
        seen.append(ids)
        if len(seen) == 4:
            raise InterruptedError
        return rows.withColumn("run", F.lit(len(seen)))

    with pytest.raises(InterruptedError):
        incremental.by_ranges(work, path, do, ranges=8)
    out = incremental.by_ranges(work.where("hash < 0"), path, do, ranges=8)  # what was dealt counts, not what is asked now
    assert sorted(r["hash"] for r in out.collect()) == list(range(200)) and len(seen) == 9
    assert sorted(x for k, ids in enumerate(seen) if k != 3 for x in ids) == list(range(200)) and sorted(seen[3]) == sorted(seen[4])
    done = incremental.finish(out, path, str(tmp_path / "target"))
    assert done.count() == 200 and listed(spark, path) == []
