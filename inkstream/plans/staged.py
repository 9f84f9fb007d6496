"""Queries over sources, sinks, caches, staged answers of models and services, and resumed work."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstream import schemas
from inkstream.functions import dates, html, keys, lists, text
from inkstream.operators import answers, gates, rows
from inkstream.plans.registry import ART, WORDS, any_sql, articles, query
from inkstream.session import folder, materialise, table
from inkstream.sources import readers, sinks, web
from inkstream.streaming import incremental


_FEED = """f AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 500 WHEN 1 THEN 404 ELSE 200 END AS status, CASE WHEN page_id % 4 < 3 THEN url END AS link, CASE WHEN page_id % 5 > 0 THEN page_id || ' news' ELSE '' END AS title, CASE WHEN page_id % 9 > 0 THEN TIMESTAMP '2024-01-08 09:00:00' END AS published_at FROM pages)"""


@query(f"""WITH {_FEED} SELECT page_id AS feed, status, CASE WHEN status = 200 THEN link END AS url, CASE WHEN status = 200 THEN nullif(title, '') END AS title, CASE WHEN status = 200 THEN published_at END AS published_at,
  CASE WHEN status <> 200 THEN 'http_' || status WHEN link IS NULL AND title = '' THEN 'no_items' WHEN link IS NULL THEN 'no_url' WHEN title = '' THEN 'no_title' WHEN published_at IS NULL THEN 'no_date' END AS reject FROM f""")
def feed_rows(spark, d):
    """Feeds made of the pages' urls, some broken; failures stay with their feed."""
    p = table(spark, d, "pages").select("page_id", "url")
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    safe = F.replace("url", F.lit("&"), F.lit("&amp;"))
    link = F.when(F.col("page_id") % 4 < 3, tag("link", safe)).otherwise("")
    title = F.when(F.col("page_id") % 5 > 0, tag("title", F.concat("page_id", F.lit(" news")))).otherwise("")
    date = tag("pubDate", F.when(F.col("page_id") % 9 > 0, "Mon, 08 Jan 2024 10:00:00 +0100").otherwise("soon"))
    body = F.concat(F.lit('<?xml version="1.0"?><rss><channel><title>x</title>'), tag("item", F.concat(title, link, date)), F.lit("</channel></rss>"))
    status = F.expr("CASE page_id % 6 WHEN 0 THEN 500 WHEN 1 THEN 404 ELSE 200 END")
    return readers.feed_items(p.select(F.col("page_id").alias("feed"), status.alias("status"), body.alias("body"))).select("feed", "status", "url", "title", "published_at", "reject")


@query(f"""WITH {ART}, s AS (SELECT doc_id, topic, url, CASE WHEN doc_id % 2 = 0 THEN url ELSE 'https://www.all.example.com/' || (doc_id % 50) END AS u, left(snippet, 300) AS snippet, (doc_id // 40) AS q, row_number() OVER (PARTITION BY topic, doc_id // 40 ORDER BY doc_id) AS pos FROM art),
c AS (SELECT * FROM s WHERE pos <= 5), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY u ORDER BY topic, q, pos) = 1)
SELECT topic, q AS query_pos, u AS url, snippet, regexp_replace(regexp_extract(u, '://([^/?#:]+)', 1), 'www[.]', '') AS domain FROM f ORDER BY topic, q, pos LIMIT 120""")
def search_answers(spark, d):
    """Staged answers of a search service: five a query, the first of each url, 120 in topic order."""
    a = articles(spark, d)
    same = F.concat(F.lit("https://www.all.example.com/"), (F.col("doc_id") % 50).cast("string"))
    staged = a.select("topic", F.col("topic").alias("topic_pos"), F.floor(F.col("doc_id") / 40).alias("query_pos"), F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 2 == 0, F.col("url")).otherwise(same).alias("url"), "snippet")
    return readers.search_results(staged, 5, 120).select("topic", "query_pos", "url", "snippet", "domain")


@query("""WITH p AS (SELECT page_id, url, html, CASE page_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 403 WHEN 2 THEN 500 ELSE 200 END AS status FROM pages)
SELECT page_id, status, CASE WHEN status IN (401, 402, 403) OR contains(lower(coalesce(CASE WHEN status > 0 THEN html END, '')), 'premium') THEN 'likely_paywalled' ELSE 'unknown' END AS paywall, status = 0 AS failed FROM p WHERE page_id % 5 > 0""")
def fetched_pages(spark, d):
    """Staged fetches that the cache lacks; a network error has status 0, and what failed before is in the
    cache too."""
    status = F.expr("CASE page_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 403 WHEN 2 THEN 500 ELSE 200 END")
    p = table(spark, d, "pages").select("page_id", F.concat("url", F.lit("#"), "page_id").alias("url"), status.alias("status"), F.when(status > 0, F.col("html")).alias("body"))
    cache = p.where("page_id % 5 = 0").select("url")
    return readers.fetched(p, cache, ["premium"]).select("page_id", "status", "paywall", "failed")


@query(f"""WITH {ART}, s AS (SELECT doc_id, url, len({WORDS.format("body")}) AS n, body FROM art), o AS (SELECT doc_id, doc_id % 3 = 0 AS old, CASE WHEN contains(lower(body), 'idiot') THEN 'paywalled' WHEN n < 200 THEN 'too_short' ELSE 'success' END AS status FROM s)
SELECT doc_id, CASE WHEN old THEN 'cache' ELSE 'new' END AS origin, status, status <> 'success' AS empty FROM o""")
def enriched_once(spark, d):
    """Texts are fetched once, whatever came of it: the cache keeps failures, too short texts and paywalls."""
    a = articles(spark, d).select("doc_id", "url", gates.podcast_status(F.col("body"), text.word_count("body"), ["idiot"], ["\x00"]).alias("now"))
    cache = a.where("doc_id % 3 = 0").select("url", F.col("now").alias("status"))
    known = a.select("doc_id", "url").join(cache, "url").select("doc_id", F.lit("cache").alias("origin"), "status")
    new = rows.unknown(a, cache, "url").select("doc_id", F.lit("new").alias("origin"), F.col("now").alias("status"))
    return known.unionByName(new).withColumn("empty", F.col("status") != "success")


@query("""WITH l AS (SELECT DISTINCT (2019 + event_id % 9)::INT AS y, (event_id % 56)::INT AS w FROM events), m AS (SELECT y || '-W' || lpad(w::VARCHAR, 2, '0') AS label, w, date_trunc('week', make_date(y, 1, 4))::DATE + (w - 1) * 7 AS monday FROM l)
SELECT label, CASE WHEN w BETWEEN 1 AND 53 AND week(monday) = w THEN timezone('UTC', timezone('Europe/Copenhagen', monday::TIMESTAMP)) END AS start,
  CASE WHEN w BETWEEN 1 AND 53 AND week(monday) = w THEN timezone('UTC', timezone('Europe/Copenhagen', monday::TIMESTAMP + INTERVAL 7 DAY - INTERVAL 1 MILLISECOND)) END AS stop FROM m""")
def week_ranges(spark, d):
    """first and last instant of labelled weeks, and none for weeks that a year has not."""
    label = F.concat((2019 + F.col("event_id") % 9).cast("string"), F.lit("-W"), F.lpad((F.col("event_id") % 56).cast("string"), 2, "0"))
    e = table(spark, d, "events").select(label.alias("label")).distinct()
    return e.select("label", dates.label_start("label").alias("start"), dates.label_end("label").alias("stop"))


@query("SELECT doc_id, CASE WHEN doc_id % 12 IN (3, 4, 5, 6, 7) THEN doc_id % 12 ELSE 7 END::INT AS shown FROM documents")
def view_sizes(spark, d):
    """How many articles a view shows."""
    return table(spark, d, "documents").select("doc_id", gates.shown_count((F.col("doc_id") % 12).cast("int")).alias("shown"))


@query(f"WITH {ART} SELECT doc_id::VARCHAR AS id, url, title, source, published_at FROM art")
def json_articles(spark, d):
    """Articles as JSON arrays of a hundred each, read by their schema and written as a new version."""
    a = articles(spark, d).select(F.floor(F.col("doc_id") / 100).alias("part"), F.col("doc_id").cast("string").alias("id"), "url", "title", "source", "published_at")
    arrays = a.groupBy("part").agg(F.to_json(F.collect_list(F.struct("id", "url", "title", "source", "published_at"))).alias("value"))
    path = folder(spark, "json")
    arrays.select("value").write.text(path)
    read = readers.json_table(spark, path, schemas.ARTICLE, lines=True).unionByName(readers.json_table(spark, path + "-none", schemas.ARTICLE))
    version = sinks.save_table(read.select("id", "url", "title", "source", "published_at"), path + "-table", 1)
    return spark.read.parquet(version)


@query("SELECT 'weeks' AS kind, count(DISTINCT strftime(ts, '%G-W%V'))::BIGINT AS n, true AS timed FROM events UNION ALL SELECT 'labels', count(DISTINCT strftime(ts, '%G-W%V')), true FROM events")
def stored_files(spark, d):
    """JSON files below a folder with one file or more a week: labels among their paths, and their times."""
    week = dates.week_label(F.col("ts"), "UTC")
    path = folder(spark, "files")
    table(spark, d, "events").select(week.alias("label"), F.lit("{}").alias("value")).distinct().withColumn("week", F.concat(F.lit("w"), "label")).repartition("week").write.partitionBy("week").json(path)
    files = readers.walk(spark, path).withColumn("path", F.replace("path", F.lit("week=w"), F.lit("")))
    timed = files.agg(F.count_distinct(F.element_at(F.split("path", "/"), -2)).alias("n"), F.min(F.col("modified").isNotNull()).alias("timed"))
    labels = readers.week_folders(files).agg(F.count(F.lit(1)).alias("n"), F.lit(True).alias("timed"))
    return timed.select(F.lit("weeks").alias("kind"), "n", "timed").unionByName(labels.select(F.lit("labels").alias("kind"), "n", "timed"))


@query("""WITH e AS (SELECT strftime(ts, '%G-W%V') AS week_label, count(*) AS n FROM events GROUP BY 1), last AS (SELECT max(week_label) AS w FROM e) SELECT week_label, CASE WHEN week_label = w THEN -n ELSE n END AS n FROM e, last""")
def week_tables(spark, d):
    """A week that is written again replaces that week alone."""
    e = table(spark, d, "events").groupBy(dates.week_label(F.col("ts"), "UTC").alias("week_label")).agg(F.count(F.lit(1)).alias("n"))
    e, path = materialise(e, "weeks"), folder(spark, "week-tables")
    sinks.save_week(e, path)
    last = e.orderBy(F.desc("week_label")).limit(1)
    sinks.save_week(last.withColumn("n", -F.col("n")), path)
    return spark.read.parquet(path).select(F.col("week_label").cast("string").alias("week_label"), "n")


@query(f"""WITH {ART}, t AS (SELECT topic, count(*) AS n FROM art GROUP BY topic) SELECT '2024-W02' AS week, 'covers/2024-W02.png' AS cover, topic, n::INT AS n, (SELECT sum(n) FROM t)::INT AS total FROM t""")
def digest_documents(spark, d):
    """One nested document of totals, written as JSON, read by its schema, its cover patched."""
    by = articles(spark, d).groupBy("topic").agg(F.count(F.lit(1)).cast("int").alias("n"))
    totals = F.struct(F.sum("n").cast("int").alias("total"), F.map_from_entries(F.collect_list(F.struct("topic", "n"))).alias("byTopic"))
    path = folder(spark, "digest")
    sinks.save_report(by.agg(F.lit("2024-W02").alias("weekLabel"), F.lit("").alias("coverImageUrl"), totals.alias("totals")), path)
    doc = sinks.patched(readers.json_table(spark, path, schemas.DIGEST), coverImageUrl="covers/2024-W02.png")
    return doc.select(F.col("weekLabel").alias("week"), F.col("coverImageUrl").alias("cover"), F.col("totals.total").alias("total"), F.explode("totals.byTopic").alias("topic", "n"))


@query("SELECT doc_id, left(sha256(doc_id::VARCHAR), 16) AS hash FROM documents WHERE doc_id % 3 > 0")
def resumed_work(spark, d):
    """A stage that is built once, and what a run that was cut off still has to do."""
    docs = table(spark, d, "documents").select("doc_id", keys.sha_short(F.col("doc_id").cast("string")).alias("hash"))
    path = folder(spark, "stage")
    done = [incremental.stage(spark, path, lambda: docs.where("doc_id % 3 = 0")) for _ in range(2)][-1]
    return incremental.remaining(docs, done)


@query("""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'old' WHEN doc_id % 3 = 1 THEN 'kept' ELSE 'new' END AS kind FROM documents) SELECT doc_id::VARCHAR AS url, CASE kind WHEN 'old' THEN CASE WHEN doc_id % 2 = 0 THEN 'filled' ELSE 'first' END WHEN 'kept' THEN 'first' ELSE 'late' END AS snippet FROM n""")
def upserted_in_batches(spark, d):
    """Two batches merged into a stored table; the second fills empty snippets and adds the rest."""
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("url"), F.col("doc_id").alias("pos"))
    path, schema = folder(spark, "upserts"), "url string, snippet string, action string"
    first = docs.where("doc_id % 3 < 2").select("url", F.when((F.col("doc_id") % 6 == 0), "").otherwise("first").alias("snippet"), "pos")
    second = docs.where("doc_id % 3 <> 1").select("url", F.when(F.col("doc_id") % 3 == 0, "filled").otherwise("late").alias("snippet"), "pos")
    for batch in (first, second):
        incremental.apply_batch(batch, path, schema)
    return incremental.versioned(spark, path, schema)[0].select("url", "snippet")


@query(f"""WITH {ART}, k AS (SELECT doc_id, unnest(['classifier', 'rerank', 'themes', 'intro', 'scene']) AS cache FROM art), c AS (SELECT *, CASE cache WHEN 'classifier' THEN doc_id % 2 = 0 WHEN 'rerank' THEN doc_id % 3 = 0 WHEN 'themes' THEN doc_id % 3 = 0 AND doc_id % 4 > 0 WHEN 'intro' THEN doc_id % 6 = 0 AND doc_id % 5 > 0 ELSE doc_id % 7 = 0 END AS hit FROM k)
SELECT cache, count(*) AS n, count(*) FILTER (hit) AS hits FROM c GROUP BY cache""")
def cache_hits(spark, d):
    """Five caches with their keys and versions: classes by url; ranks, themes and intros by fingerprint, model and
    version; scenes by key."""
    a = articles(spark, d).select("doc_id", "url", keys.sha_short("url").alias("fingerprint"))
    i, out = F.col("doc_id"), None
    caches = {
        "classifier": (["url"], {"version": "v2"}, "true", {"version": F.when(i % 2 == 0, "v2").otherwise("v1")}),
        "rerank": (["fingerprint"], {"model": "m"}, "doc_id % 3 = 0", {"model": F.lit("m")}),
        "themes": (["fingerprint"], {"model": "m", "version": "v3"}, "doc_id % 3 = 0", {"model": F.lit("m"), "version": F.when(i % 4 > 0, "v3").otherwise("v1")}),
        "intro": (["fingerprint"], {"model": "m", "version": "v1"}, "doc_id % 2 = 0", {"model": F.when(i % 3 == 0, "m").otherwise("old"), "version": F.when(i % 5 > 0, "v1")}),
        "scene": (["fingerprint"], {"version": "v1"}, "doc_id % 7 = 0", {"version": F.lit("v1")}),
    }
    for name, (by, wanted, stored, columns) in caches.items():
        cache = a.where(stored).select(*by, *[x.alias(k) for k, x in columns.items()])
        one = rows.cached(a, cache, by, wanted).agg(F.lit(name).alias("cache"), F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))
        out = one if out is None else out.unionByName(one)
    return out


_OK = r"(len(list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')) BETWEEN 2 AND 6 AND NOT regexp_matches({0}, '[.,;:!?]'))"


@query(rf"""WITH {ART}, s AS (SELECT doc_id, array_to_string(string_split(title, ' ')[1:doc_id % 9], ' ') AS one, CASE WHEN doc_id % 4 > 0 THEN 'Margin compression' || CASE WHEN doc_id % 3 = 0 THEN '!' ELSE '' END END AS two FROM art)
SELECT doc_id, CASE WHEN {_OK.format("one")} THEN 'first' WHEN two IS NOT NULL AND {_OK.format("two")} THEN 'retry' ELSE 'first_despite_issues' END AS origin, CASE WHEN NOT {_OK.format("one")} AND two IS NOT NULL AND {_OK.format("two")} THEN two ELSE one END AS theme FROM s""")
def retried_themes(spark, d):
    """Staged answers: the first if it is valid, else a valid retry, else the first with its issues."""
    one = F.array_join(F.slice(F.split("title", " "), 1, (F.col("doc_id") % 9).cast("int")), " ")
    two = F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("Margin compression"), F.when(F.col("doc_id") % 3 == 0, "!").otherwise("")))
    a = articles(spark, d).select("doc_id", one.alias("one"), two.alias("two"))
    ok = lambda x: ~F.arrays_overlap(text.theme_issues(x), F.array(*[F.lit(i) for i in ("too_short", "too_long", "punctuation")]))
    origin, chosen = text.first_valid(F.col("one"), F.col("two"), ok("one"), ok("two"))
    return a.select("doc_id", origin.alias("origin"), chosen.alias("theme"))


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN (n_chars % 100) / 100.0 END AS c, doc_id % 3 = 0 AS issues FROM documents), p AS (SELECT *, CASE WHEN issues THEN greatest(0, c - 0.15) ELSE c END AS conf FROM s)
SELECT doc_id, CASE WHEN c IS NULL THEN 'no_answer' WHEN conf < 0.55 THEN 'low_confidence' ELSE 'model' END AS origin, round(CASE WHEN conf >= 0.55 THEN conf END, 9)::DOUBLE AS confidence FROM p""")
def scene_choices(spark, d):
    """A staged scene with its penalty; the fallback below 0.55 or without an answer."""
    c = F.when(F.col("doc_id") % 5 > 0, (F.col("n_chars") % 100) / 100.0)
    conf = text.penalised(c, F.col("doc_id") % 3 == 0)
    origin = F.when(c.isNull(), "no_answer").when(conf < 0.55, "low_confidence").otherwise("model")
    return table(spark, d, "documents").select("doc_id", origin.alias("origin"), F.round(F.when(conf >= 0.55, conf), 9).alias("confidence"))


@query(rf"""WITH {ART}, s AS (SELECT doc_id, CASE WHEN doc_id % 6 > 0 THEN snippet END AS snippet, CASE WHEN doc_id % 4 > 0 THEN body END AS answer FROM art)
SELECT CASE WHEN coalesce(snippet, '') = '' THEN 'skipped' WHEN answer IS NULL THEN 'failed' ELSE 'succeeded' END AS outcome, count(*) AS n FROM s GROUP BY 1""")
def summary_counters(spark, d):
    """Summaries that were made, skipped for want of a snippet, or failed."""
    snippet, answer = F.when(F.col("doc_id") % 6 > 0, F.col("snippet")), F.when(F.col("doc_id") % 4 > 0, F.col("body"))
    a = articles(spark, d).select(text.summary_outcome(snippet, answer).alias("outcome"))
    return a.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""WITH {ART}, s AS (SELECT doc_id, len(string_split_regex(body, '\s+')) AS one, len(string_split_regex(body || ' ' || body || ' ' || title, '\s+')) AS two FROM art)
SELECT doc_id, CASE WHEN one >= 225 THEN 'first' WHEN two >= 225 THEN 'retry' ELSE 'expand' END AS step FROM s""")
def script_steps(spark, d):
    """A staged script by its words: long enough, written again, or to be expanded (a tenth of the usual length here)."""
    words = text.token_count
    return articles(spark, d).select("doc_id", text.script_step(words("body"), words(F.concat_ws(" ", "body", "body", "title")), 225).alias("step"))


_TYPES = list(lists.ANCHORS)
_MORE = "CASE doc_id % 4 WHEN 0 THEN ' shopper in a mall' WHEN 1 THEN ' phone tag' WHEN 2 THEN ' customer analyst' ELSE '' END"
_FIRST = ", ".join(f"CASE {' '.join(f'''WHEN contains(x, '{t}') THEN '{v}' ''' for t, v in ms)} END AS {k}" for k, ms in lists.ANCHORS.items())


@query(f"""WITH {ART}, x AS (SELECT doc_id // 3 AS cover, doc_id, lower(title || ' ' || snippet || {_MORE}) AS x FROM art), t AS (SELECT cover, doc_id, {_FIRST} FROM x),
e AS (SELECT cover, doc_id AS pos, unnest([{", ".join(f"'{k}'" for k in _TYPES)}]) AS type, unnest([{", ".join(_TYPES)}]) AS description, unnest([0, 1, 2]) AS i FROM t), f AS (SELECT * FROM e WHERE description IS NOT NULL),
d(type, description, i) AS (VALUES ('person', 'professional', 0), ('place', 'modern retail environment', 1), ('object', 'technology device', 2)),
g AS (FROM f UNION ALL SELECT c.cover, 9223372036854775807, d.type, d.description, d.i FROM (SELECT DISTINCT cover FROM t) c, d WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.cover = c.cover AND f.type = d.type)),
o AS (SELECT *, row_number() OVER (PARTITION BY cover, type ORDER BY pos, i) > 1 AS later FROM g), u AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY cover, description ORDER BY later, pos, i) = 1)
SELECT cover, row_number() OVER (PARTITION BY cover ORDER BY later, pos, i)::INT AS place, type, description FROM u QUALIFY place <= 3""")
def anchor_choices(spark, d):
    """Three visual anchors for each cover, from the anchors (F36) of its articles."""
    more = F.expr(_MORE)
    a = articles(spark, d).select(F.floor(F.col("doc_id") / 3).alias("cover"), F.col("doc_id").alias("pos"), text.anchors(F.concat(F.concat_ws(" ", "title", "snippet"), more)).alias("anchors"))
    return rows.anchor_picks(a, ["cover"])


_SENTENCE = "trim(string_split_regex(snippet, '[.!?]')[1], ' ' || chr(9) || chr(10) || chr(13))"
_CLOSED = "CASE WHEN regexp_matches(trim(title), '[.!?]$') THEN trim(title) ELSE trim(title) || '.' END"
_RETAIL = any_sql("title", ["retail", "commerce", "luxury", "ecommerce", "shopping", "customer"])


@query(f"""WITH {ART}, s AS (SELECT doc_id // 3 AS cover, doc_id, title, coalesce(CASE WHEN length({_SENTENCE}) > 20 AND length({_SENTENCE}) < 200 THEN {_SENTENCE} END, regexp_replace(title, '[.!?]', '', 'g') || '.') AS happening,
  CASE WHEN title = '' THEN 'This development affects retail and ecommerce strategies.' WHEN {_RETAIL} THEN {_CLOSED} ELSE {_CLOSED} || ' This impacts retail and ecommerce operations.' END AS matters FROM art),
n AS (SELECT *, row_number() OVER (PARTITION BY cover ORDER BY doc_id) AS k FROM s)
SELECT cover, string_agg('Article ' || k || ': ' || title, chr(10) ORDER BY k) AS articles, string_agg('- ' || happening || ' ' || matters, chr(10) ORDER BY k) AS narrative FROM n GROUP BY cover""")
def cover_stories(spark, d):
    """The parts of a cover's prompt that come from its articles: their list, and a line of narrative (F33, F34) each."""
    a = articles(spark, d).select(F.floor(F.col("doc_id") / 3).alias("cover"), "doc_id", "title", text.whats_happening(F.lit(None).cast("string"), "snippet", "title").alias("happening"), text.why_it_matters("title").alias("matters"))
    a = rows.top_k(a, ["cover"], ["doc_id"], 4, "k")  # a cover has four stories at most
    line = F.struct("k", F.concat(F.lit("Article "), F.col("k").cast("string"), F.lit(": "), "title").alias("article"), F.concat(F.lit("- "), "happening", F.lit(" "), "matters").alias("story"))
    g = a.groupBy("cover").agg(F.array_sort(F.collect_list(line)).alias("l"))
    return g.select("cover", F.array_join(F.transform("l", lambda x: x["article"]), "\n").alias("articles"), F.array_join(F.transform("l", lambda x: x["story"]), "\n").alias("narrative"))


@query(f"""WITH {ART}, h AS (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN 'Sat' END AS t, CASE doc_id % 4 WHEN 0 THEN '12 March 2024' WHEN 1 THEN '3 days ago' WHEN 2 THEN 'soon' ELSE '' END AS x FROM art)
SELECT doc_id, 'https://s.example.com/' || doc_id AS url, 'Item ' || doc_id AS title, CASE WHEN doc_id % 4 = 2 AND doc_id % 2 = 0 THEN 'soon' ELSE nullif(x, '') END AS date_text FROM h WHERE doc_id % 3 < 2""")
def item_dates_beside(spark, d):
    """items whose date stands beside them: in the next text, after the link, or in the item's own text."""
    x = F.expr("CASE doc_id % 4 WHEN 0 THEN '12 March 2024' WHEN 1 THEN '3 days ago' WHEN 2 THEN 'soon' ELSE '' END")
    i = F.col("doc_id").cast("string")
    anchor = F.concat(F.lit('<a href="/'), i, F.lit('">Item '), i, F.lit("</a>"))
    beside = F.concat(F.lit("<h2>"), anchor, F.lit("</h2>"), x)
    after = F.concat(F.lit("<h2>"), anchor, F.lit(" "), x, F.lit("</h2>"))
    page = F.when(F.col("doc_id") % 3 == 0, beside).when(F.col("doc_id") % 3 == 1, after).otherwise("<h2>no link</h2>")
    find = html.items("h2", "a", beside=True)
    a = articles(spark, d).select("doc_id", page.alias("html"), F.lit("https://s.example.com/x").alias("base"))
    return a.select("doc_id", F.explode(find("html", "base")).alias("i")).where("i.url IS NOT NULL").select("doc_id", "i.url", "i.title", "i.date_text")


_SERVED = """s AS (SELECT url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), 'www\\.', '') AS host, html, page_id,
  CASE WHEN page_id % 13 = 0 THEN 0 WHEN page_id % 7 = 0 THEN 0 WHEN page_id % 11 = 0 THEN 403 WHEN page_id % 5 = 0 THEN 500 ELSE 200 END AS status FROM pages)"""


def _served(spark, d):
    """The pages as a source: some do not answer, some too late, some refuse."""
    i = F.col("page_id")
    status = F.when(i % 7 == 0, 0).when(i % 11 == 0, 403).when(i % 5 == 0, 500).otherwise(200)
    requests = table(spark, d, "pages").select("url", "page_id", status.alias("status"), F.col("html").alias("body"), F.when(i % 13 == 0, 60_000).otherwise(5).alias("delay_ms"))
    path = folder(spark, "frontier")
    return web.pages(spark, path, web.frontier(requests, path), "staged", deadline=1.0)


@query(f"""WITH {_SERVED} SELECT url, host, status, CASE WHEN status = 200 THEN md5(html) END AS body, CASE WHEN page_id % 13 = 0 THEN 'timeout' WHEN status = 0 THEN 'network: ConnectionError' WHEN status <> 200 THEN 'http_' || status END AS error FROM s""")
def served_pages(spark, d):
    """Pages by way of the fetching source; two at once, a deadline each, errors as rows."""
    return _served(spark, d).select("url", "host", "status", F.md5("body").alias("body"), "error")


@query(f"""WITH {_SERVED}, h AS (SELECT min(host) AS host FROM s) SELECT s.url, s.host, status FROM s JOIN h USING (host) WHERE contains(lower(html), 'the') AND status = 200""")
def site_search(spark, d):
    """A query's ``site:`` operator becomes a filter on the host that the source itself applies."""
    first = table(spark, d, "pages").agg(F.min(keys.without_www(keys.host("url"))).alias("host")).first()["host"]
    asked = spark.range(1).select(F.concat(F.lit("the site:"), F.lit(first)).alias("q")).select(keys.site_of("q").alias("site"), keys.without_site("q").alias("term")).first()
    found = _served(spark, d).where(F.col("host") == asked["site"])
    return found.where(F.lower("body").contains(asked["term"])).select("url", "host", "status")


@query("SELECT doc_id::VARCHAR AS url, 's' || doc_id AS snippet, true AS unchanged FROM documents")
def upserted_stream(spark, d):
    """T01 as a stream: two generations of each row arrive in micro-batches, the first of them without some snippets; then
    the stream is replayed from its start, which changes nothing."""
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("url"), F.concat(F.lit("s"), "doc_id").alias("snippet"), F.col("doc_id").alias("pos"))
    first = docs.withColumn("snippet", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("snippet")))
    arrived, path, schema = folder(spark, "arrived"), folder(spark, "streamed"), "url string, snippet string, action string"
    first.union(docs).drop("doc_id").repartition(4).write.parquet(arrived)
    versions = []
    for run in ("one", "two"):
        stream = spark.readStream.schema("url string, snippet string, pos long").option("maxFilesPerTrigger", 1).parquet(arrived)
        incremental.upsert_stream(stream, path, schema, folder(spark, f"offsets-{run}")).awaitTermination()
        versions.append(incremental.versioned(spark, path, schema)[1])
    return incremental.versioned(spark, path, schema)[0].select("url", "snippet", F.lit(versions[0] == versions[1]).alias("unchanged"))


@query("""WITH s AS (SELECT unnest([1, 2, 3]) AS step), t AS (SELECT step, coalesce(lang, '-') AS lang, CASE WHEN step = 3 AND doc_id = (SELECT min(doc_id) FROM documents) THEN n_chars + 1 ELSE n_chars END AS n FROM documents, s)
SELECT step, step <> 2 AS built, lang, count(*) AS n, sum(n)::BIGINT AS chars FROM t GROUP BY step, lang""")
def rebuilt_stage(spark, d):
    """A stage over documents is built, found again for the same rows in another order, and built anew after one
    row has changed."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("-")).alias("lang"), "n_chars")
    least = docs.agg(F.min("doc_id")).first()[0]
    changed = docs.withColumn("n_chars", F.col("n_chars") + (F.col("doc_id") == F.lit(least)).cast("long"))
    path, out = folder(spark, "memo"), None
    for step, rows in enumerate((docs, docs.repartition(7, "n_chars"), changed), 1):
        built = []

        def build(rows=rows, built=built):
            built.append(True)
            return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))

        made = incremental.stage(spark, path, build, [rows])
        one = materialise(made.select(F.lit(step).alias("step"), F.lit(bool(built)).alias("built"), "lang", "n", "chars"), "step")
        out = one if out is None else out.union(one)
    return out


@query("SELECT doc_id, left(sha256(doc_id::VARCHAR), 16) AS hash, CASE WHEN sha256(doc_id::VARCHAR) < '9' THEN 'first' ELSE 'second' END AS run FROM documents")
def ledgered_work(spark, d):
    """Work by ranges of the hash; the first run is stopped in the tenth of sixteen, the second does the rest."""
    docs = table(spark, d, "documents").select("doc_id", keys.sha_short(F.col("doc_id").cast("string")).alias("hash"))
    path, digit = folder(spark, "ledger"), F.conv(F.substring("hash", 1, 1), 16, 10)

    def work(run, most):
        left = iter(range(most))

        def do(rows):
            if next(left, None) is None:
                raise InterruptedError
            return rows.withColumn("run", F.lit(run))

        return incremental.by_ranges(docs, path, do, "hash", 16, digit)

    try:
        work("first", 9)
    except InterruptedError:
        pass
    return incremental.finish(work("second", 16), path, folder(spark, "ledgered"))


@query("""WITH s AS (SELECT source, lang, count(*) AS n, sum((n_chars > 1000)::INT)::BIGINT AS long FROM documents GROUP BY ALL), t AS (SELECT source, sum(n)::BIGINT AS candidates, sum(long)::BIGINT AS excluded, bool_or(long > 2) AS relaxed, count(*) AS topics FROM s GROUP BY source)
SELECT source, length(source) % 2 = 0 AS nested, candidates, excluded, relaxed, CASE WHEN length(source) % 2 = 0 THEN topics ELSE 0 END AS topics FROM t""")
def report_shapes(spark, d):
    """Selection reports of both shapes, flat and ``{aggregated, by_topic}``, in one variant column."""
    docs = table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("n_chars") > 1000).cast("long")).alias("long"))
    body = lambda n, long, relaxed: F.struct(n.alias("candidate_count"), F.struct(long.alias("domainCap")).alias("exclusion_counts"), F.struct(relaxed.alias("domainCapRelaxed")).alias("fallback_used"))
    topics = F.map_from_entries(F.collect_list(F.struct(F.coalesce("lang", F.lit("-")), body(F.col("n"), F.col("long"), F.col("long") > 2))))
    own = docs.groupBy("source").agg(body(F.sum("n"), F.sum("long"), F.bool_or(F.col("long") > 2)).alias("whole"), topics.alias("by_topic"))
    flat, nested = F.to_json("whole"), F.to_json(F.struct(F.col("whole").alias("aggregated"), "by_topic"))
    files = own.select("source", F.when(F.length("source") % 2 == 0, nested).otherwise(flat).alias("json"))
    r = readers.selection_report(readers.variant(files, "json"))
    return r.select("source", "nested", "candidates", "excluded", "relaxed", "topics")


@query("""WITH s AS (SELECT *, doc_id % 9 AS k, (n_chars % 100) / 100.0 AS c FROM documents), f AS (SELECT doc_id, k, CASE k WHEN 7 THEN 0.5 WHEN 6 THEN greatest(0, c - 0.15) WHEN 8 THEN greatest(0, c - 0.15) ELSE c END AS conf,
  CASE WHEN k = 0 THEN 'no_answer' WHEN k = 1 THEN 'no_json' WHEN k = 2 THEN 'no_prompt' WHEN k = 3 THEN 'no_anchors' WHEN k = 4 AND doc_id % 2 = 0 THEN 'no_technique' END AS bad FROM s),
g AS (SELECT *, coalesce(bad, CASE WHEN conf < 0.55 THEN 'low_confidence' END) AS fault FROM f)
SELECT doc_id, CASE WHEN fault IS NOT NULL THEN 'fallback' WHEN k = 4 THEN 'retry' ELSE 'first' END AS origin, fault, CASE WHEN fault IS NULL THEN round(conf, 9)::DOUBLE END AS confidence, CASE WHEN fault IS NULL THEN 'scene ' || doc_id END AS prompt, CASE WHEN fault IS NULL THEN CASE WHEN k = 5 THEN 'own' ELSE 'text,logos' END END AS negative FROM g""")
def scene_answers(spark, d):
    """Staged scenes of all shapes: without JSON, prompt, anchors or technique, fenced, vague, and second tries."""
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 9
    c = F.format_string("%.2f", (F.col("n_chars") % 100) / 100.0)

    def answer(prompt=True, anchors='{"person": "a baker"}', technique='["contrast"]', note="a baker weighs gold on kitchen scales", confidence=None, negative=""):
        head = [F.lit('{"finalImagePrompt": "scene '), i, F.lit('", ')] if prompt else [F.lit("{")]
        return F.concat(*head, F.lit(f'"visualAnchors": {anchors}, "boringnessBreaker": {{"selected": {technique}, "executionNote": "{note}"}}{negative}, "confidence": '), c if confidence is None else confidence, F.lit("}"))

    fenced = F.concat(F.lit("```json\n"), answer(negative=', "negativePrompt": ["own"]'), F.lit("\n```"))
    ways = [F.lit(None).cast("string"), F.lit("sorry"), answer(prompt=False), answer(anchors='"none"'), answer(technique="[]"), fenced, answer(note="a funny picture of it all"), answer(confidence=F.lit('"high"')), answer(note="short")]
    one = None
    for n, way in enumerate(ways):
        one = F.when(k == n, way) if one is None else one.when(k == n, way)
    two = F.when(F.col("doc_id") % 2 == 0, answer(technique="null")).otherwise(answer())
    rows_ = table(spark, d, "documents").select("doc_id", one.alias("one"), two.alias("two"))
    return answers.scenes(rows_, "one", "two", ["text", "logos"]).select("doc_id", "origin", "fault", F.round("confidence", 9).alias("confidence"), "prompt", F.array_join("negative", ",").alias("negative"))


@query("""WITH s AS (SELECT doc_id, doc_id % 5 AS k FROM documents) SELECT doc_id, CASE k WHEN 0 THEN 'no_json' WHEN 1 THEN 'not_exactly_3' WHEN 2 THEN 'blank' WHEN 3 THEN 'blank' END AS fault, CASE WHEN k = 4 THEN 'q' || doc_id || '|b|c' END AS queries FROM s""")
def delta_answers(spark, d):
    """Staged answers that must hold exactly three queries, none of them blank."""
    k, q = F.col("doc_id") % 5, F.concat(F.lit('"q'), F.col("doc_id").cast("string"), F.lit('"'))
    answer = lambda rest: F.concat(F.lit('{"deltaQueries": ['), q, F.lit(rest + "]}"))
    one = F.when(k == 0, "no").when(k == 1, answer(', "b"')).when(k == 2, answer(', " ", "c"')).when(k == 3, answer(', 7, "c"')).otherwise(answer(', "b", "c"'))
    queries, fault = answers.delta_queries(one)
    return table(spark, d, "documents").select("doc_id", fault.alias("fault"), F.array_join(queries, "|").alias("queries"))


_PLACES = "Stories:\n{articles}\n\nIn the picture: {anchors}.\n\nWhat happens:\n{narrative}\n"


@query(f"""WITH {ART}, s AS (SELECT doc_id // 3 AS cover, doc_id, title, coalesce(CASE WHEN length({_SENTENCE}) > 20 AND length({_SENTENCE}) < 200 THEN {_SENTENCE} END, regexp_replace(title, '[.!?]', '', 'g') || '.') AS happening,
  CASE WHEN title = '' THEN 'This development affects retail and ecommerce strategies.' WHEN {_RETAIL} THEN {_CLOSED} ELSE {_CLOSED} || ' This impacts retail and ecommerce operations.' END AS matters FROM art),
n AS (SELECT *, row_number() OVER (PARTITION BY cover ORDER BY doc_id) AS k FROM s)
SELECT cover, 'Stories:' || chr(10) || string_agg('Article ' || k || ': ' || title, chr(10) ORDER BY k) || chr(10) || chr(10) || 'In the picture: professional, modern retail environment, technology device.' || chr(10) || chr(10) || 'What happens:' || chr(10) || string_agg('- ' || happening || ' ' || matters, chr(10) ORDER BY k) || chr(10) AS prompt FROM n GROUP BY cover""")
def cover_prompts(spark, d):
    """A cover's whole prompt: a template, its articles, three anchors (the fixed ones here) and the narrative."""
    stories = cover_stories(spark, d)
    none = F.array().cast("array<struct<type: string, description: string>>")
    picks = rows.anchor_picks(stories.select("cover", F.lit(0).alias("pos"), none.alias("anchors")), ["cover"])
    anchors = picks.groupBy("cover").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "description"))), lambda x: x["description"]), ", ").alias("anchors"))
    return stories.join(anchors, "cover").select("cover", answers.composed(_PLACES, articles=F.col("articles"), anchors=F.col("anchors"), narrative=F.col("narrative")).alias("prompt"))
