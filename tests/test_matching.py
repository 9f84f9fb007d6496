"""Keyword automata, names that contain each other: against loops."""

import random
import re

from pyspark.sql import functions as F

from inkstream.functions import automaton, text
from inkstream.operators import gates, matching


def stands(keyword, x, edges):
    k = keyword.lower()
    if edges == automaton.WHOLE or edges == automaton.SHORT_WHOLE and len(k) <= 3:
        return re.search(rf"(?<![A-Za-z0-9_]){re.escape(k)}(?![A-Za-z0-9_])", x.lower()) is not None
    return k in x.lower()


def test_hits_against_loops(spark):
    """Overlapping keywords, keywords in several lists and under several rules, odd edges, empty lists and texts."""
    rng = random.Random(1)
    some = lambda most: "".join(rng.choice("abA é-1_") for _ in range(rng.randint(1, most)))
    lists = {"short": [some(5) for _ in range(30)], "any": ([some(4) for _ in range(30)], automaton.ANYWHERE), "whole": ([some(4) for _ in range(30)], automaton.WHOLE), "none": []}
    lists["again"] = (lists["short"], automaton.ANYWHERE)
    texts = [some(40) for _ in range(200)] + ["", None, "a", "a-a", "-a", "ab ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, x string")
    hits = automaton.Hits(F.col("x"), lists)
    got = {r["id"]: r for r in df.select("id", *[hits.count(n).alias(n) for n in lists], hits.any("whole").alias("some")).collect()}
    for i, x in enumerate(texts):
        for name, of in lists.items():
            keywords, edges = of if isinstance(of, tuple) else (of, automaton.SHORT_WHOLE)
            want = None if x is None else sum(stands(k, x, edges) for k in dict.fromkeys(keywords))
            assert got[i][name] == want, (x, name)
        assert got[i]["some"] == (None if x is None else got[i]["whole"] > 0)


def test_one_pass_for_many_names(spark):
    """Ten thousand names in three fields, by one Arrow function; names and boosts as a loop gives them."""
    rng = random.Random(2)
    names = list({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 9))) for _ in range(10_000)})
    some = lambda n: " ".join(rng.choice(names) if rng.random() < 0.3 else "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows = [(i, some(4), some(40), some(10) if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, t string, b string, s string")
    found, boost = text.company_hits(F.col("t"), F.col("b"), F.col("s"), names)
    out = df.select("id", found.alias("names"), boost.alias("boost"))
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    for r in out.collect():
        _, t, b, s = rows[r["id"]]
        each = {n: 6 if n in t else 4 if n in b else 2 if n in (s or "") else 0 for n in names}
        assert list(r["names"]) == [n for n in names if each[n]] and r["boost"] == min(10, sum(each.values()))


def test_gates_look_once(spark):
    """All of a gate's lists are looked for in one pass."""
    m = gates.Markers(["ad"], ["war", "riot"], ["tariff"], ["shop"], word_boundary=True)
    df = spark.createDataFrame([("war",), ("warm",), ("war shop",), ("war tariffs",), ("adder",), ("an ad",)], "x string")
    hits = m.hits(F.col("x"))
    out = df.select("x", gates.controversy(hits, m).alias("c"), gates.hard_controversy(hits, m).alias("h"), hits.any("sponsored").alias("s"))
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {r["x"]: (r["c"], r["h"], r["s"]) for r in out.collect()} == {
        "war": ("controversial", True, False), "warm": ("none", False, False), "war shop": ("suspected", True, False), "war tariffs": ("none", False, False), "adder": ("none", False, False), "an ad": ("none", False, True),
    }


def test_names_that_contain_each_other(spark):
    """Against a nested loop: short and long names, other cases, repeats, blanks and nulls."""
    rng = random.Random(4)
    some = lambda: "".join(rng.choice("abABé ") for _ in range(rng.choice((0, 1, 2, 3, 4, 6, 12))))
    left, right = [some() for _ in range(120)] + [None, "", "a", "A"], [some() for _ in range(120)] + [None, "", "aa", "a"]
    df = lambda names: spark.createDataFrame([(n,) for n in names], "n string")
    got = sorted((r["left"], r["right"]) for r in matching.name_matches(df(left), df(right)).collect())
    want = {(a, b) for a in left for b in right if a and b and (a.lower() in b.lower() or b.lower() in a.lower())}
    assert got == sorted(want) and len(want) > 100
    assert matching.name_matches(df(left).limit(0), df(right)).count() == 0


def test_names_of_large_tables(spark):
    """Two tables of 100,000 names: no Cartesian plan, and the pairs that a nested loop over a part of them gives."""
    name = lambda seed: F.concat_ws(" ", *[F.element_at(F.array(*[F.lit(w) for w in ("north", "south", "gold", "ring", "house", "trade", "shop", "data")]), (F.pmod(F.xxhash64("id", F.lit(seed + i)), F.lit(8)) + 1).cast("int")) for i in range(2)], F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(70_000)).cast("string"))
    left = spark.range(100_000).select(name(1).alias("n"))
    right = spark.range(100_000).select(F.concat(name(5), F.when(F.col("id") % 2 == 0, F.lit(" ltd")).otherwise(F.lit(""))).alias("n"))
    out = matching.name_matches(left, right)
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = {(r["left"], r["right"]) for r in out.collect()}
    some, others = {r["n"] for r in left.limit(300).collect()}, {r["n"] for r in right.collect()}
    assert {p for p in got if p[0] in some} == {(a, b) for a in some for b in others if a in b or b in a}
    assert len(got) > 100
