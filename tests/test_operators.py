"""Operators against loops and small fixtures."""

import datetime as dt
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkstream import schemas
from inkstream.functions import dates, html, keys, text
from inkstream.operators import gates, rows
from inkstream.sources import readers, sinks
from inkstream.streaming import incremental


def test_diverse_top_equals_the_greedy_walk(spark):
    rng = random.Random(5)
    data, want = [], {}
    for g in range(60):
        m, kinds = rng.randint(1, 14), rng.randint(1, 4)
        group = [(g, f"s{rng.randint(1, kinds)}", f"u{i:03}") for i in range(m)]
        data += group
        chosen, used = [], {}
        for i, (_, s, u) in enumerate(group):
            if len(chosen) < 7 and (used.get(s, 0) < 3 or 7 - len(chosen) >= m - i):
                chosen.append(u)
                used[s] = used.get(s, 0) + 1
        want[g] = chosen
    df = spark.createDataFrame(data, "g int, source string, url string")
    got = {}
    for r in rows.diverse_top(df, ["g"], "source", "url").orderBy("g", "rank").collect():
        got.setdefault(r["g"], []).append(r["url"])
    assert got == want


def test_capped_top_equals_two_passes(spark):
    rng = random.Random(6)
    data, want = [], {}
    for g in range(60):
        group = [(g, f"d{rng.randint(1, 3)}", r) for r in range(rng.randint(1, 12))]
        data += group
        taken, used = [], {}
        for cap in (2, 3):
            for _, d, r in group:
                if len(taken) < 5 and r not in taken and used.get(d, 0) < cap:
                    taken.append(r)
                    used[d] = used.get(d, 0) + 1
        want[g] = taken
    got = {}
    for r in rows.capped_top(spark.createDataFrame(data, "g int, domain string, rank int"), ["g"], "domain", "rank", 5).orderBy("g", "place").collect():
        got.setdefault(r["g"], []).append(r["rank"])
    assert got == want


def test_select_ranked(spark):
    titles = ["gold rush today", "gold rush today", "a b c d e f", "new ring", "old ring", "x y"]
    data = [("t", f"u{i}", t, "d", i + 1, i == 3, False, i in (0, 2)) for i, t in enumerate(titles)]
    df = spark.createDataFrame(data, "topic string, url string, bare_title string, domain string, rank int, hard boolean, sponsored boolean, paywalled boolean")
    got = {r["url"]: (r["place"], r["verdict"]) for r in rows.select_ranked(df, "topic", 4).collect()}
    assert got["u1"][1] == "duplicate" and got["u3"][1] == "hardControversy" and got["u4"][1] == "domainCap"
    assert got["u0"][0] == 1 and got["u2"][0] is None  # of two paywalled ones the best-ranked stays
    worst = {r["url"]: r["place"] for r in rows.select_ranked(df, "topic", 4, keep_best=False).collect()}
    assert worst["u0"] is None and worst["u2"] == 1


def test_near_titles_with_repeated_words(spark):
    """Against all pairs; first the example of a pair whose rarest words differ."""
    rng = random.Random(7)
    shared = [f"s{i}" for i in range(1, 7)]
    titles = [("g", 0, ["the"] * 3 + shared + ["n1", "n2"]), ("g", 1, ["the", *shared, "m1", "m2", "m3", "m4"]), *[("g", i, ["the", *shared]) for i in range(2, 5)]]
    for i in range(5, 300):
        words = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))]
        titles.append((f"g{i % 3}", i, words))
    want = {(g, i, j): sum(w in y for w in x) / max(len(x), len(y)) for g, i, x in titles for h, j, y in titles if g == h and i < j}
    want = {k: v for k, v in want.items() if v > 0.8}
    df = spark.createDataFrame([(g, i, " ".join(w)) for g, i, w in titles], "g string, id long, title string")
    got = {(r["g"], r["a"], r["b"]): r["overlap"] for r in rows.near_titles(df, "g", "id", "title").collect()}
    assert ("g", 0, 1) in want and got == want


def test_titles_that_share_rare_words_alone_are_no_candidates(spark, monkeypatch):
    """Marks tell most of them before they leave the join; without marks they all do."""
    rng = random.Random(5)
    common = [f"c{k}" for k in range(30)]
    titles = [(i, [f"p{i % 10}", *rng.sample(common, 9)]) for i in range(40)]
    titles += [(100 + i, w[:-1] + ["z"]) for i, w in titles[:5]]
    df = spark.createDataFrame([("g", i, " ".join(w)) for i, w in titles], "g string, id long, title string")
    want = {(i, j) for i, x in titles for j, y in titles if i < j and sum(w in y for w in x) / 10 > 0.8}
    found = {(r["a"], r["b"]) for r in rows.title_candidates(df, "g", "id", "title").collect()}
    monkeypatch.setattr(rows, "_lacking", lambda a, b: F.lit(0))
    assert len(want) >= 5 and want <= found and len(found) <= 2 * len(want) and rows.title_candidates(df, "g", "id", "title").count() >= 30


def test_near_titles_of_many_words(spark):
    """Titles of 500 words, most of them repeated: few pairs are compared, none is lost; nulls and blanks pair with nothing."""
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 4000}" for _ in range(60_000)]
    titles = []
    for i in range(160):
        words = rng.sample(vocabulary, rng.choice((480, 500, 520)))
        titles.append((i, words))
        if i % 8 == 0:  # a copy with a few words changed
            titles.append((1000 + i, [w if rng.random() > 0.08 else f"x{rng.randint(0, 9)}" for w in words]))
        if i % 20 == 0:  # far fewer words, but those that the first one repeats
            common = [w for w, n in Counter(words).most_common(60)]
            titles.append((2000 + i, common))
    titles += [(3000, ["w0"] * 400 + ["w1"]), (3001, ["w0"]), (3002, ["w1", "w0"])]
    want = {}
    sets = {j: set(y) for j, y in titles}
    length = {j: len(y) for j, y in titles}
    for i, x in titles:
        for j in sets:
            if i < j and (v := sum(w in sets[j] for w in x) / max(len(x), length[j])) > 0.8:
                want[(i, j)] = v
    df = spark.createDataFrame([("g", i, " ".join(w)) for i, w in titles] + [("g", 4000, None), ("g", 4001, " "), (None, 4002, "w0")], "g string, id long, title string")
    got = {(r["a"], r["b"]): r["overlap"] for r in rows.near_titles(df, "g", "id", "title").collect()}
    assert len(want) >= 20 and (3000, 3001) in want and got == want
    assert rows.title_candidates(df, "g", "id", "title").count() <= 10 * len(want)


def test_newest_wins_twice_changes_nothing(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", dt.datetime(2024, 1, 2), 2), ("a", dt.datetime(2024, 1, 2), 3), ("b", None, 4)], "k string, at timestamp, pos int")
    once = rows.newest_wins(df, ["k"], "at", "pos")
    assert sorted((r["k"], r["pos"], r["first_pos"]) for r in once.collect()) == [("a", 2, 1), ("b", 4, 4)]
    assert rows.newest_wins(once.drop("first_pos"), ["k"], "at", "pos").count() == 2


def test_row_operators_against_loops(spark):
    """Random groups with ties, nulls and repeated keys: first, last and newest row, repeats, the first of a title."""
    rng = random.Random(11)
    data = [(rng.choice(["a", "b", None]), rng.choice(["x", "y", "z", None]), i, rng.randint(0, 1), rng.choice([None, *(dt.datetime(2024, 1, d) for d in (1, 2, 3))])) for i in range(200)]
    df = spark.createDataFrame(data, "k string, t string, pos int, prio int, at timestamp")
    by = {}
    for r in data:
        by.setdefault(r[:2], []).append(r)
    zero = dt.datetime(1970, 1, 1)
    assert {tuple(r) for r in rows.first_wins(df, ["k", "t"], ["pos"]).collect()} == {g[0] for g in by.values()}
    last = {(*max(g, key=lambda r: (r[3], r[2]))[:2], g[0][2], *max(g, key=lambda r: (r[3], r[2]))[3:]) for g in by.values()}
    assert {tuple(r) for r in rows.last_wins(df, ["k", "t"], "prio", "pos").collect()} == last
    newest = {(*max(g, key=lambda r: (r[4] or zero, -r[2])), g[0][2]) for g in by.values()}
    assert {tuple(r) for r in rows.newest_wins(df, ["k", "t"], "at", "pos").collect()} == newest
    assert {(r["pos"], r["dup"]) for r in rows.repeats(df, ["t"], "pos").collect()} == {(r[2], min(x[2] for x in data if x[1] == r[1]) < r[2]) for r in data}
    urls = df.withColumn("url", F.col("pos").cast("string"))
    assert {(r["pos"], r["duplicate_of"]) for r in rows.duplicate_of(urls, ["k"], "t", "url", "pos").collect()} == {(r[2], str(by[r[:2]][0][2])) for r in data}


def test_diverse_top_without_a_pool(spark):
    """Large groups, so that a source's first and last rows are needed."""
    rng = random.Random(8)
    data, want = [], {}
    for g in range(30):
        m, kinds = rng.randint(1, 60), rng.randint(1, 3)
        group = [(g, f"s{rng.randint(1, kinds)}", f"u{i:03}") for i in range(m)]
        data += group
        chosen, used = [], {}
        for i, (_, s, u) in enumerate(group):
            if len(chosen) < 9 and (used.get(s, 0) < 2 or 9 - len(chosen) >= m - i):
                chosen.append(u)
                used[s] = used.get(s, 0) + 1
        want[g] = chosen
    got = {}
    for r in rows.diverse_top(spark.createDataFrame(data, "g int, source string, url string"), ["g"], "source", "url", 9, 2, None).orderBy("g", "rank").collect():
        got.setdefault(r["g"], []).append(r["url"])
    assert got == want


def test_anchor_picks(spark):
    """The first of each type, a filled third place, defaults, and a group without anchors."""
    data = [("a", 1, [("person", "p1"), ("person", "p2")]), ("a", 2, [("person", "p1"), ("place", "l1")]), ("b", 1, [("object", "o1")]), ("b", 2, None), ("c", 1, [])]
    df = spark.createDataFrame(data, "k string, pos int, anchors array<struct<type: string, description: string>>")
    got = {}
    for r in rows.anchor_picks(df, ["k"]).orderBy("k", "place").collect():
        got.setdefault(r["k"], []).append(r["description"])
    assert got == {"a": ["p1", "l1", "technology device"], "b": ["o1", "professional", "modern retail environment"], "c": ["professional", "modern retail environment", "technology device"]}


def test_merge_week(spark):
    """Known by url, known by title, new, and a row of the week without a snippet."""
    t = lambda *r: spark.createDataFrame(list(r), "url string, title string, snippet string")
    new = t(("u1", "One", "s"), ("u2", " KNOWN  title", "s"), ("u3", "Three", ""), ("u4", "Four", "late")).withColumn("pos", F.monotonically_increasing_id())
    got = {r["url"]: (r["snippet"], r["action"]) for r in rows.merge_week(new, t(("u1", "x", "s"), ("k", "Known title", "s")), t(("u4", "Four", None), ("u5", "Five", "old"))).collect()}
    assert got == {"u3": (None, "added"), "u4": ("late", "updated"), "u5": ("old", "kept")}


def test_keywords_and_dates_beside(spark):
    x = spark.createDataFrame([("Gold.gem AI model", "a"), ("paid plain", "b"), (None, "c")], "t string, k string")
    got = [tuple(r) for r in x.select(text.contains_any("t", ["d.g"]).alias("a"), text.contains_any("t", ["ai"], True).alias("b"), text.keyword_count("t", ["ai", "gem", "model", "zzzz"]).alias("n"), text.keyword_any("t", ["ai"]).alias("k")).collect()]
    assert got == [(True, True, 3, True), (False, False, 0, False), (None, None, None, None)]
    page = html.parse("<div><h2><a href='/1'>One</a></h2>12 March 2024</div><li><a href='/2'>Two</a> by us, 3 days ago</li><li>no link</li>")
    beside = [html.date_beside(n, n.first("a")) for n in [*page.select("h2"), *page.select("li")]]
    assert beside == ["12 March 2024", "by us, 3 days ago", ""]


def test_chunks_equal_the_fold(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["ab ", "c", ". ", "! ", "word "]) for _ in range(rng.randint(0, 120))) for _ in range(80)] + ["", "no end", "..."]
    got = [r["c"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(text.chunks("t", 40).alias("c")).collect()]
    import re

    for t, chunks in zip(texts, got, strict=True):
        want, now = [], ""
        for s in re.findall(r"[^.!?]+[.!?]+", t) or [t]:
            if len(now) + len(s) > 40 and now:
                want.append(now.strip(" "))
                now = s
            else:
                now += s
        if now.strip(" "):
            want.append(now.strip(" "))
        assert chunks == want


def test_weeks(spark):
    t = spark.sql("SELECT * FROM VALUES (TIMESTAMP '2025-12-17 10:00:00'), (TIMESTAMP '2026-03-29 12:00:00'), (TIMESTAMP '2025-12-29 12:00:00') v(t)")
    r = t.select(dates.week_start(F.col("t")).alias("a"), dates.week_end(F.col("t")).alias("b"), dates.week_label(F.col("t")).alias("l"), dates.week_label(F.col("t"), calendar_year=True).alias("c")).collect()
    assert [x["l"] for x in r] == ["2025-W51", "2026-W13", "2026-W01"] and r[2]["c"] == "2025-W01"
    assert r[1]["b"] - r[1]["a"] == dt.timedelta(days=7, hours=-1, milliseconds=-1)
    a, b = dates.label_range("2026-W13")
    assert a == dt.datetime(2026, 3, 22, 23, tzinfo=dt.UTC) and b.hour == 21
    with pytest.raises(ValueError):
        dates.label_range("2025-W53")


def test_hash_and_urls(spark):
    r = spark.sql("SELECT 'https://WWW.Example.com:8080/a/b/?q=1#x' AS u, 'hello' AS s").select(keys.canonical("u").alias("c"), keys.short_hash("s").alias("h"), keys.without_www(keys.host("u")).alias("d")).first()
    assert r["c"] == "https://www.example.com/a/b?q=1" and r["d"] == "example.com"
    h = 5381
    for ch in "hello":
        h = (h * 33 + ord(ch)) & 0xFFFFFFFF
    h, out = abs(h - (1 << 32) if h >= 1 << 31 else h), ""
    while h:
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[h % 36] + out
        h //= 36
    assert r["h"] == out


def test_gate_order(spark):
    w = spark.sql("SELECT 'discovery' AS source_type, TIMESTAMP '2023-11-01' AS published_at, false AS published_invalid, TIMESTAMP '2024-01-10' AS discovered_at UNION ALL SELECT 'discovery', TIMESTAMP '2023-11-01', true, TIMESTAMP '2024-01-10' UNION ALL SELECT NULL, NULL, false, NULL UNION ALL SELECT 'consultancy', TIMESTAMP '2024-01-07', false, TIMESTAMP '2024-01-10'")
    start, end = F.expr("TIMESTAMP '2024-01-08'"), F.expr("TIMESTAMP '2024-01-14 23:59:59'")
    assert [(r["reject"], r["via"]) for r in gates.window(w, start, end).collect()] == [("too_old", None), (None, "discovered"), ("missing_date", None), ("outside", None)]


def test_feeds(spark):
    rss = "<rss><channel><title>x</title><item><title>A</title><link>http://a</link><pubDate>Mon, 08 Jan 2024 10:00:00 GMT</pubDate><description>d</description></item><item><title>B</title><link>http://b</link><pubDate>bad</pubDate></item></channel></rss>"
    got = {(r["feed"], r["url"]): r["reject"] for r in readers.feed_items(spark.createDataFrame([("f", 200, rss), ("g", 500, ""), ("h", 200, "no xml")], "feed string, status int, body string")).collect()}
    assert got == {("f", "http://a"): None, ("f", "http://b"): "no_date", ("g", None): "http_500", ("h", None): "no_items"}


def test_html(spark):
    page = "<html><head><title>T</title><meta name=author content=Ann></head><body><script>x</script><article>" + "word " * 150 + "<p>end</p></article><div class='teaser'><h2>One</h2><a href='/1'>go</a><time datetime='2024-01-02'>x</time></div></body></html>"
    body, title, author, date = html.article(page)
    assert title == "T" and author == "Ann" and date == "2024-01-02" and body.endswith("end") and "x" not in body.split()
    found = spark.createDataFrame([(page, "http://s/p")], "html string, url string").select(html.items(".teaser", "a", "h2", "time")("html", "url").alias("i")).first()["i"]
    assert [tuple(i) for i in found] == [("One", "http://s/1", "2024-01-02")]
    assert html.article("")[0] == "" and html.article("<p>broken <b>x")[0] == "broken x"
    raw = spark.createDataFrame([('{"A": ["A", {"b": "A"}]}',), (None,)], "j string")
    once = raw.select(html.renamed({"A": "Z"})("j").alias("j"))
    assert [r["j"] for r in once.select(html.renamed({"A": "Z"})("j").alias("j")).collect()] == ['{"Z": ["Z", {"b": "Z"}]}', None]


def test_json_sources_and_sinks(spark, tmp_path):
    assert readers.json_table(spark, str(tmp_path / "none"), schemas.ARTICLE).count() == 0
    d = tmp_path / "weeks" / "2024-W02"
    d.mkdir(parents=True)
    (d / "a.json").write_text(json.dumps([{"url": "u1", "title": "t"}, {"url": "u2", "extra": 1}]))
    (d / "bad.json").write_text("[{")
    assert {r["url"] for r in readers.json_table(spark, str(d / "a.json"), schemas.ARTICLE).collect()} == {"u1", "u2"}
    assert [r["url"] for r in readers.json_table(spark, str(d / "bad.json"), schemas.ARTICLE).collect()] == [None]
    files = readers.walk(spark, str(tmp_path / "weeks"))
    assert [r["week"] for r in readers.week_folders(files).collect()] == ["2024-W02"] and files.where("modified IS NOT NULL").count() == 2
    df = spark.createDataFrame([("2024-W01", 1), ("2024-W02", 2)], "week_label string, x int")
    out = str(tmp_path / "out")
    sinks.save_week(df, out)
    sinks.save_week(df.where("x = 2").withColumn("x", F.lit(9)), out)
    assert sorted((r["week_label"], r["x"]) for r in spark.read.parquet(out).collect()) == [("2024-W01", 1), ("2024-W02", 9)]
    assert sinks.save_table(df, out + "2", 0) is None and spark.read.parquet(sinks.save_table(df, out + "2", 1)).count() == 2
    sinks.save_report(df.agg(F.struct(F.sum("x").alias("x")).alias("totals")), out + "3")
    doc = spark.read.json(out + "3")
    assert sinks.patched(doc, cover="c.png", totals__x="7").select("cover", "totals.x").first() == ("c.png", "7")
    assert sinks.lines(df, {"week_label": 10, "x": -4}).first()["line"] == "2024-W01     1"
    q = tmp_path / "q.json"
    q.write_text(json.dumps({"A": [str(i) for i in range(12)]}))
    assert readers.base_queries(spark, str(q)).count() == 12
    with pytest.raises(Exception, match="12 queries"):
        q.write_text(json.dumps({"A": ["1"]}))
        readers.base_queries(spark, str(q)).collect()


def test_staged_services(spark):
    staged = spark.createDataFrame([(0, 0, i, "t", f"https://www.x.com/{i % 3}", "a", "s" * 400) for i in range(5)] + [(1, 0, 0, "u", "https://y.com/1", "b", None)], "topic_pos int, query_pos int, pos int, topic string, url string, title string, snippet string")
    got = readers.search_results(staged, 4, 3).orderBy("topic_pos", "pos").collect()
    assert [r["url"][-1] for r in got] == ["0", "1", "2"] and got[0]["domain"] == "x.com" and len(got[0]["snippet"]) == 300
    assert readers.search_results(staged, 4, 3, per_topic=True).count() == 4
    long = "c" * 250
    bodies = [json.dumps({"results": [{"url": "u", "content": "", "raw_content": long}]}), json.dumps([{"content": long}]), json.dumps({"results": [{"content": "short"}]}), "no"]
    assert [r["t"] for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(readers.api_text("b").alias("t")).collect()] == [long, long, None, None]
    fetched = readers.fetched(spark.createDataFrame([("a", 200, "x"), ("b", 0, None), ("c", 403, "")], "url string, status int, body string"), spark.createDataFrame([("a",)], "url string"))
    assert {r["url"]: (r["paywall"], r["failed"]) for r in fetched.collect()} == {"b": ("unknown", True), "c": ("likely_paywalled", False)}


def test_incremental(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "url string, snippet string, action string"
    one = spark.createDataFrame([("a", "", 0), ("b", "x", 1), ("a", "later", 2)], "url string, snippet string, pos int")
    assert incremental.apply_batch(one, path, schema) == {"added": 2}
    two = spark.createDataFrame([("a", "now", 0), ("c", "y", 1)], "url string, snippet string, pos int")
    assert incremental.apply_batch(two, path, schema) == {"added": 1, "updated": 1}  # b's bucket is not touched
    assert incremental.apply_batch(two, path, schema) == {"kept": 2}
    assert incremental.versioned(spark, path, schema)[0].count() == 3 and incremental.versioned(spark, path, schema)[1] == 3
    import os

    rows = {f for r in spark.read.parquet(f"{path}/versions/v3").collect() for f in [r["folder"]]}
    assert len(rows) == 3 and len(os.listdir(f"{path}/data")) == 3  # one bucket each; folders of version 1 that nobody names are gone
    src = tmp_path / "in"
    two.withColumn("url", F.concat("url", F.lit("2"))).write.parquet(str(src))
    stream = spark.readStream.schema("url string, snippet string, pos int").parquet(str(src))
    incremental.upsert_stream(stream, path, schema, str(tmp_path / "cp")).awaitTermination(60)
    assert incremental.versioned(spark, path, schema)[0].count() == 5
    made = []
    for _ in range(2):
        incremental.stage(spark, str(tmp_path / "s"), lambda: made.append(1) or spark.range(3))
    assert made == [1] and incremental.remaining(spark.range(5).withColumnRenamed("id", "hash"), spark.range(2).withColumnRenamed("id", "hash")).count() == 3


def test_llm_answers(spark):
    got = [r["v"] for r in spark.createDataFrame([(json.dumps({"category": "A"}),), ('```json\n{"category": "B"}\n```',), ("{}",), (None,)], "x string").select(text.fenced_json("x", "category string", "category")["category"].alias("v")).collect()]
    assert got == ["A", "B", None, None]
    assert [gates.shown_n(n) for n in (3, 7, 2, 99)] == [3, 7, 7, 7]


def test_released_tables(spark):
    from inkstream import session

    kept = session._written[:]
    session._written.clear()
    df = session.materialise(spark.range(3).toDF("x"), "released")
    assert df.count() == 3 and session.release(spark) == 1
    spark.catalog.clearCache()
    try:
        assert df.count() == -1
    except Exception as e:
        assert "FILE_NOT_EXIST" in str(e) or "does not exist" in str(e)
    session._written.extend(kept)
