"""Answers of models by shape."""

import json

import pytest
from pyspark.sql import functions as F

from inkstream.operators import answers
from inkstream.sources import readers


def scene(**changes):
    whole = {"finalImagePrompt": "p", "visualAnchors": {"person": "a"}, "boringnessBreaker": {"selected": ["contrast"], "executionNote": "a baker weighs gold on scales"}, "confidence": 0.9}
    return json.dumps({k: v for k, v in (whole | changes).items() if v is not None})


def test_scenes(spark):
    note = lambda x: {"selected": ["c"], "executionNote": x}
    none = scene(boringnessBreaker={"selected": []})
    rows = {
        "good": (scene(), None, ("first", None, 0.9)), "fenced": (f"```json\n{scene()}\n```", None, ("first", None, 0.9)), "anchor list": (scene(visualAnchors=["a"]), None, ("first", None, 0.9)),
        "no answer": (None, scene(), ("fallback", "no_answer", None)), "blank": ("", None, ("fallback", "no_answer", None)), "no json": ("{", scene(), ("fallback", "no_json", None)),
        "list": ("[]", scene(), ("fallback", "no_prompt", None)), "no prompt": (scene(finalImagePrompt=7), scene(), ("fallback", "no_prompt", None)), "no anchors": (scene(visualAnchors="a"), scene(), ("fallback", "no_anchors", None)),
        "retry": (none, scene(confidence=1), ("retry", None, 1.0)), "retry in vain": (none, none, ("fallback", "no_technique", None)), "retry unanswered": (scene(boringnessBreaker=None), None, ("fallback", "no_answer", None)),
        "unsure": (scene(confidence=0.5), None, ("fallback", "low_confidence", None)), "no number": (scene(confidence="0.9"), None, ("fallback", "low_confidence", None)),
        "vague": (scene(boringnessBreaker=note("an INTERESTING picture of it")), None, ("first", None, 0.75)), "short": (scene(boringnessBreaker=note("too short")), None, ("first", None, 0.75)), "no note": (scene(boringnessBreaker={"selected": ["c"]}), None, ("first", None, 0.75)),
    }
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in rows.items()], "k string, one string, two string")
    got = {r["k"]: (r["origin"], r["fault"], r["confidence"] and round(r["confidence"], 9)) for r in answers.scenes(df, "one", "two", ["text"]).collect()}
    assert got == {k: want for k, (*_, want) in rows.items()}
    lists = {r["k"]: r["negative"] and list(r["negative"]) for r in answers.scenes(spark.createDataFrame([("own", scene(negativePrompt=["x"]), None), ("none", scene(negativePrompt="x"), None)], "k string, one string, two string"), "one", "two", ["text"]).collect()}
    assert lists == {"own": ["x"], "none": ["text"]}


def test_delta_queries(spark):
    rows = {'{"deltaQueries": ["a", "b", "c"]}': (["a", "b", "c"], None), '{"deltaQueries": ["a", "b"]}': (None, "not_exactly_3"), "{}": (None, "not_exactly_3"), '{"deltaQueries": "abc"}': (None, "not_exactly_3"), '{"deltaQueries": ["a", " ", "c"]}': (None, "blank"), '{"deltaQueries": ["a", 1, "c"]}': (None, "blank"), "x": (None, "no_json")}
    df = spark.createDataFrame([(k,) for k in rows], "a string")
    queries, fault = answers.delta_queries("a")
    assert {r["a"]: (r["q"] and list(r["q"]), r["f"]) for r in df.select("a", queries.alias("q"), fault.alias("f")).collect()} == rows


def test_composed(spark):
    df = spark.createDataFrame([("x", None)], "a string, b string")
    assert df.select(answers.composed("{a}-{b}-{a}.", a=F.col("a"), b=F.col("b")).alias("t")).first()["t"] == "x--x."
    with pytest.raises(ValueError, match="b"):
        answers.composed("{b}", a=F.col("a"))


def test_reports_of_both_shapes(spark):
    flat = {"candidate_count": 5, "ranked_top_k_count": 4, "selected_count": 3, "exclusion_counts": {"domainCap": 1, "duplicate": 2}, "fallback_used": {"domainCapRelaxed": True}}
    rows = {"flat": json.dumps(flat), "nested": json.dumps({"aggregated": flat, "by_topic": {"A": flat, "B": flat}}), "empty": "{}", "bad": "{", "null": None}
    df = readers.selection_report(readers.variant(spark.createDataFrame(list(rows.items()), "k string, json string"), "json"))
    got = {r["k"]: tuple(r[c] for c in ("nested", "candidates", "ranked", "selected", "excluded", "relaxed", "topics")) for r in df.collect()}
    none = (False, 0, 0, 0, 0, False, 0)
    assert got == {"flat": (False, 5, 4, 3, 3, True, 0), "nested": (True, 5, 4, 3, 3, True, 2), "empty": none, "bad": none, "null": none}


def test_unknown_times_are_now(spark):
    df = spark.createDataFrame([(0,), (1_700_000_000,), (None,)], "s long").select(F.timestamp_seconds("s").alias("t"))
    got = [r["m"].timestamp() for r in df.select(readers.modified("t").alias("m")).collect()]
    assert got[1] == 1_700_000_000 and got[0] > 1_750_000_000 and got[2] == got[0]
