"""Queries over gates, joins, deduplication, classification, ranking and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstream.functions import automaton, lists, text
from inkstream.operators import classify, gates, matching, rows
from inkstream.plans.registry import ART, BARE, END, PLAIN, START, WORDS, any_sql, articles, count_sql, query, scored_sql
from inkstream.session import table

LOCAL = gates.Markers(lists.LOCAL_SPONSORED, lists.LOCAL_CONTROVERSY, lists.LOCAL_POLICY, lists.LOCAL_CONTEXT)
_TOPIC = scored_sql("x", lists.LOCAL_TOPICS, "'Ecommerce_Retail_Tech'")


def _x(*columns: str):
    return F.concat_ws(" ", *columns)


@query(f"""WITH {ART}, t AS (SELECT *, lower(title || ' ' || source) AS x, {PLAIN.format("title")} AS norm FROM art), c AS (SELECT *, {_TOPIC} AS found FROM t),
d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY found, norm ORDER BY published_at DESC, doc_id) = 1), p AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY found ORDER BY url) <= 100),
n AS (SELECT *, row_number() OVER (PARTITION BY found, source ORDER BY url) AS rn, count(*) OVER (PARTITION BY found) AS m FROM p), o AS (SELECT *, sum((rn > 3)::INT) OVER (PARTITION BY found ORDER BY url ROWS UNBOUNDED PRECEDING) AS over FROM n)
SELECT found AS topic, row_number() OVER (PARTITION BY found ORDER BY url)::INT AS rank, doc_id, title, source, url FROM o WHERE rn <= 3 OR over > greatest(m - 7, 0) QUALIFY rank <= 7""")
def weekly_top(spark, d):
    """Flagship: articles, normalised titles (F20), topics (C01's scores), newest of each title (D03), diverse top seven."""
    a = articles(spark, d)
    a = a.withColumns({"found": classify.scored(automaton.Hits(_x("title", "source"), lists.LOCAL_TOPICS), list(lists.LOCAL_TOPICS)), "norm": text.title_plain("title")}).select("doc_id", "title", "source", "url", "published_at", "found", "norm")
    top = rows.diverse_top(rows.newest_wins(a, ["found", "norm"], "published_at", "doc_id"), ["found"], "source", "url")
    return top.select(F.col("found").alias("topic"), "rank", "doc_id", "title", "source", "url")


_SRC = f"""CASE WHEN {any_sql("source", lists.JEWELLERY_SOURCES)} THEN 'Jewellery_Industry' WHEN {any_sql("source", lists.ECOMMERCE_SOURCES)} THEN CASE WHEN {count_sql("x", lists.STRONG_AI)} > 0 THEN 'AI_and_Strategy' ELSE 'Ecommerce_Retail_Tech' END
  WHEN {any_sql("source", lists.LUXURY_SOURCES)} THEN 'Luxury_and_Consumer' WHEN {any_sql("source", lists.AI_SOURCES)} THEN 'AI_and_Strategy' ELSE """
_NAMES = "CASE doc_id % 40 WHEN 0 THEN 'JCK Online' WHEN 1 THEN 'Luxury Daily - Retail' WHEN 2 THEN 'WWD' WHEN 3 THEN 'MIT Technology Review - AI' ELSE source END"
_MORE = "CASE doc_id % 9 WHEN 0 THEN ' gold gem' WHEN 1 THEN ' checkout online store' WHEN 2 THEN ' luxury' WHEN 3 THEN ' openai benchmark' ELSE '' END"


@query(f"""WITH {ART}, n AS (SELECT doc_id, title || {_MORE} AS title, {_NAMES} AS source, body, snippet FROM art), t AS (SELECT *, lower(title || ' ' || source) AS x FROM n)
SELECT doc_id, {_SRC} {scored_sql("x", classify.KEYWORDS, f"CASE WHEN {count_sql('x', lists.SPECIFIC_LUXURY)} > 0 THEN 'Luxury_and_Consumer' ELSE 'Ecommerce_Retail_Tech' END")} END AS topic,
  CASE {" ".join(f"WHEN {any_sql('t', ms)} THEN '{k}'" for k, ms in lists.DISCOVERY_TERMS.items())} ELSE 'Ecommerce_Retail_Tech' END AS discovery FROM (SELECT *, title || ' ' || snippet || ' ' || body AS t FROM t)""")
def topics(spark, d):
    """C01 and C02 with their own lists, over articles with a few named sources and added words."""
    a = articles(spark, d).withColumns({"source": F.expr(_NAMES), "title": F.concat("title", F.expr(_MORE))})
    return a.select("doc_id", classify.topic(F.col("title"), F.col("source")).alias("topic"), classify.discovery_topic(_x("title", "snippet", "body")).alias("discovery"))


_SUPPORT = "CASE rule_topic " + " ".join(f"WHEN '{t}' THEN {count_sql('x', ks)}" for t, ks in lists.LOCAL_TOPICS.items()) + " END"


@query(f"""WITH {ART}, l AS (SELECT doc_id, quality, toxic FROM labels), t AS (SELECT art.*, lower(title || ' ' || source) AS x, quality, toxic FROM art LEFT JOIN l USING (doc_id)), r AS (SELECT *, {_TOPIC} AS rule_topic FROM t), h AS (SELECT *, {_SUPPORT} AS hits FROM r),
o AS (SELECT *, CASE WHEN doc_id % 5 = 0 AND doc_id % 2 = 0 THEN 'cache' WHEN quality IS NULL THEN 'fallback' WHEN quality = 0 THEN 'low_confidence' ELSE 'model' END AS origin, CASE WHEN doc_id % 2 = 0 THEN 'Luxury_and_Consumer' END AS hint FROM h)
SELECT doc_id, origin, CASE origin WHEN 'cache' THEN 'Jewellery_Industry' WHEN 'model' THEN topic WHEN 'low_confidence' THEN CASE WHEN hits < 2 AND hint IS NOT NULL THEN hint ELSE rule_topic END ELSE rule_topic END AS topic,
  CASE origin WHEN 'cache' THEN 0.9 WHEN 'model' THEN 0.8 WHEN 'low_confidence' THEN 0.3 ELSE CASE WHEN hits >= 2 THEN 0.4 WHEN hits = 1 THEN 0.3 ELSE 0.2 END END::DOUBLE AS confidence FROM o""")
def hybrid_topics(spark, d):
    """Cache by key and version, then staged predictions (from ``labels``), then the rules."""
    a = articles(spark, d)
    cache = a.where("doc_id % 5 = 0").select("url", F.lit("Jewellery_Industry").alias("cached_topic"), F.lit(0.9).alias("cached_confidence"), F.when(F.col("doc_id") % 2 == 0, "v2").otherwise("v1").alias("cached_version"))
    model = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, 0.8).otherwise(0.5).alias("model_confidence"))
    a = a.join(cache, "url", "left").join(model, "doc_id", "left").withColumn("model_topic", F.when(F.col("model_confidence").isNotNull(), F.col("topic")))
    a = a.withColumn("hint", F.when(F.col("doc_id") % 2 == 0, "Fashion & Luxury"))
    x = F.lower(_x("title", "source"))
    hits = automaton.Hits(x, lists.LOCAL_TOPICS)
    rule = classify.scored(hits, list(lists.LOCAL_TOPICS))
    done = classify.hybrid(a, "v2", rule, classify.support(hits, rule, list(lists.LOCAL_TOPICS)))
    return done.select("doc_id", "origin", "topic", "confidence")


_WIN = f"""v AS (SELECT *, published_at BETWEEN {START} - INTERVAL 1 DAY AND {END} + INTERVAL 1 DAY AND NOT published_invalid AS by_date, discovered_at BETWEEN {START} AND {END} AS by_find, published_at BETWEEN {START} AND {END} AS strict FROM art),
w AS (SELECT *, CASE WHEN source_type <> 'discovery' THEN CASE WHEN NOT strict THEN 'outside' END WHEN NOT published_invalid AND published_at < {START} - INTERVAL 30 DAY THEN 'too_old' WHEN by_date THEN NULL WHEN discovered_at < {START} - INTERVAL 30 DAY THEN 'too_old' WHEN NOT by_find THEN 'outside' END AS reject FROM v)"""


@query(f"""WITH {ART}, {_WIN} SELECT doc_id, reject, CASE WHEN reject IS NULL THEN CASE WHEN source_type = 'discovery' AND NOT by_date THEN 'discovered' ELSE 'published' END END AS via,
  CASE WHEN reject IS NULL AND source_type = 'discovery' AND NOT by_date THEN discovered_at ELSE published_at END AS published_at FROM w""")
def week_window(spark, d):
    """P02, P03, T07."""
    return gates.window(articles(spark, d), F.expr(START), F.expr(END)).select("doc_id", "reject", "via", "published_at")


@query(f"""WITH {ART} SELECT topic, count(*) AS n, count(*) FILTER (published_at BETWEEN {START} AND {END}) AS strict, count(*) FILTER (published_at BETWEEN {START} - INTERVAL 1 DAY AND {END} + INTERVAL 1 DAY) AS soft,
  count(*) FILTER (published_at BETWEEN {START} - INTERVAL 1 DAY AND {END} + INTERVAL 1 DAY AND NOT published_at BETWEEN {START} AND {END}) AS gained,
  array_to_string([strftime(x, '%Y-%m-%d') FOR x IN list(published_at ORDER BY doc_id) FILTER (published_at BETWEEN {START} AND {END})[1:3]], ',') AS samples FROM art GROUP BY topic""")
def window_effect(spark, d):
    """Strict against soft windows, with sample dates."""
    day = F.expr("INTERVAL 1 DAY")
    strict, soft = F.col("published_at").between(F.expr(START), F.expr(END)), F.col("published_at").between(F.expr(START) - day, F.expr(END) + day)
    a = articles(spark, d).select("topic", "doc_id", "published_at", strict.alias("strict"), soft.alias("soft"))
    counts = a.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.count_if("strict").alias("s"), F.count_if("soft").alias("f"), F.count_if(F.col("soft") & ~F.col("strict")).alias("gained"))
    three = rows.top_k(a.where("strict"), ["topic"], ["doc_id"], 3, "k").groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("k", F.date_format("published_at", "yyyy-MM-dd").alias("x")))).alias("l"))
    joined = counts.join(three, "topic", "left")
    return joined.select("topic", "n", F.col("s").alias("strict"), F.col("f").alias("soft"), "gained", F.array_join(F.transform("l", lambda v: v["x"]), ",").alias("samples"))


@query(f"""WITH {ART}, t AS (SELECT *, title || ' ' || snippet AS x, title || ' ' || snippet || ' ' || body AS y FROM art) SELECT doc_id,
  CASE WHEN NOT {any_sql("x", LOCAL.controversy)} OR {any_sql("x", LOCAL.policy)} THEN 'none' WHEN {any_sql("x", LOCAL.context)} THEN 'suspected' ELSE 'controversial' END AS state,
  {any_sql("y", LOCAL.controversy)} AND NOT {any_sql("y", LOCAL.policy)} AS hard, {any_sql("x", lists.CONTROVERSY)} AND NOT {any_sql("x", lists.POLICY)} AS default_hard FROM t""")
def controversies(spark, d):
    """P06, P07, with the corpus's lists and with the default ones."""
    return articles(spark, d).select("doc_id", gates.controversy(_x("title", "snippet"), LOCAL).alias("state"), gates.hard_controversy(_x("title", "snippet", "body"), LOCAL).alias("hard"), gates.hard_controversy(_x("title", "snippet"), gates.Markers()).alias("default_hard"))


@query(f"""WITH {ART}, {_WIN}, u AS (SELECT *, first_value(url) OVER (PARTITION BY topic, {PLAIN.format("title")} ORDER BY doc_id) AS dup, title || ' ' || snippet AS x FROM w), f AS (SELECT *, reject IS NULL AS inside, {any_sql("x", LOCAL.sponsored)} AS spons, dup <> url AS isdup,
  CASE WHEN NOT {any_sql("x", LOCAL.controversy)} OR {any_sql("x", LOCAL.policy)} THEN 'none' WHEN {any_sql("x", LOCAL.context)} THEN 'suspected' ELSE 'controversial' END AS state FROM u),
r AS (SELECT *, list_filter([CASE WHEN NOT inside THEN reject END, CASE WHEN inside AND spons THEN 'sponsored' END, CASE WHEN inside AND isdup THEN 'duplicate' END, CASE WHEN inside AND NOT isdup AND state = 'controversial' THEN 'controversial' END, CASE WHEN inside AND NOT isdup AND state = 'suspected' THEN 'suspected' END], lambda x: x IS NOT NULL) AS l FROM f)
SELECT doc_id, inside AND NOT isdup AND state <> 'controversial' AS eligible, CASE WHEN len(l) = 0 THEN 'eligible' ELSE array_to_string(l, ',') END AS reasons, CASE WHEN inside AND isdup THEN dup END AS duplicate_of FROM r""")
def gated(spark, d):
    """Every gate, its reasons and flags."""
    a = articles(spark, d).withColumn("norm", text.title_plain("title"))
    a = rows.duplicate_of(a, ["topic"], "norm", "url", "doc_id")
    return gates.gate(a, F.expr(START), F.expr(END), LOCAL).select("doc_id", "eligible", F.array_join("reasons", ",").alias("reasons"), "flags.duplicate_of")


@query(f"""WITH p AS (SELECT page_id, html, CASE page_id % 10 WHEN 0 THEN 403 WHEN 1 THEN 401 WHEN 2 THEN 500 ELSE 200 END AS status, regexp_replace(html, '<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, CASE WHEN status IN (401, 402, 403) OR {any_sql("html", ["store", "idiot"])} THEN 'likely_paywalled' ELSE 'unknown' END AS status, CASE WHEN regexp_matches(t, '(?i)that the') THEN 'that the' WHEN regexp_matches(t, '(?i)of the') THEN 'of the' END AS reason,
  CASE WHEN NOT (status IN (401, 402, 403)) AND len({WORDS.format("t")}) < 200 THEN 'likely_paywalled' ELSE 'unknown' END AS by_length FROM p""")
def paywalls(spark, d):
    """P09, P10, P11, with markers that occur in the corpus."""
    p = table(spark, d, "pages").withColumns({"code": F.expr("CASE page_id % 10 WHEN 0 THEN 403 WHEN 1 THEN 401 WHEN 2 THEN 500 ELSE 200 END"), "t": F.regexp_replace("html", "<[^>]*>", " ")})
    short = F.when(~F.col("code").isin(401, 402, 403) & (text.word_count("t") < 200), "likely_paywalled").otherwise("unknown")
    return p.select("page_id", gates.paywall_status(F.col("code"), F.col("html"), ["store", "idiot"]).alias("status"), gates.paywall_reason(F.col("t"), ["that the", "of the"]).alias("reason"), short.alias("by_length"))


_EXT = rf"""e AS (SELECT *, len({WORDS.format("body")}) AS n, length(regexp_replace(body, '[^\x00-\x7F]', '', 'g')) / nullif(length(body), 0) > 0.95 AS en, contains(lower(body), 'store') AS pay FROM art),
r AS (SELECT *, CASE WHEN NOT coalesce(en, false) THEN 'non_english' WHEN n < 200 AND NOT pay THEN 'too_short' WHEN regexp_matches(body, '(?i)not found|^the |idiot') THEN 'not_article' END AS reject FROM e)"""


def _extracted(spark, d):
    a = articles(spark, d)
    return a.withColumn("reject", gates.extraction_reject(F.col("body"), text.word_count("body"), text.contains_any("body", ["store"]), text.is_english("body", 0.95), ["not found", "^the ", "idiot"]))


@query(f"WITH {ART}, {_EXT} SELECT doc_id, reject, CASE WHEN regexp_matches(body, '(?i)idiot|clown') THEN 'paywalled' WHEN regexp_matches(left(body, greatest(500, floor(length(body) * 0.2)::INT)), '(?i)not found|^the |worthless') THEN 'extraction_failed' WHEN n < 200 THEN 'too_short' ELSE 'success' END AS podcast FROM r")
def extraction_rejects(spark, d):
    """P12, P13."""
    return _extracted(spark, d).select("doc_id", "reject", gates.podcast_status(F.col("body"), text.word_count("body"), ["idiot", "clown"], ["not found", "^the ", "worthless"]).alias("podcast"))


@query(f"WITH {ART}, {_EXT} SELECT topic, count(*) FILTER (reject IS NULL) AS kept, count(*) FILTER (reject = 'non_english') AS non_english, count(*) FILTER (reject = 'too_short') AS too_short, count(*) FILTER (reject = 'not_article') AS not_article, 0::BIGINT AS paywalled FROM r GROUP BY topic")
def extraction_report(spark, d):
    """A05."""
    n = lambda r: F.count_if(F.col("reject") == r).alias(r)
    return _extracted(spark, d).groupBy("topic").agg(F.count_if(F.col("reject").isNull()).alias("kept"), n("non_english"), n("too_short"), n("not_article"), F.lit(0).cast("long").alias("paywalled"))


_NEW = "new AS (SELECT url, CASE WHEN doc_id % 4 = 1 THEN '' ELSE snippet END AS snippet, title, doc_id FROM art WHERE doc_id % 2 = 1 OR doc_id % 10 = 0), known AS (SELECT url, CASE WHEN doc_id % 20 = 0 THEN '' ELSE snippet END AS snippet, title, doc_id FROM art WHERE doc_id % 2 = 0)"


def _batches(spark, d):
    a = articles(spark, d)
    new = a.where("doc_id % 2 = 1 OR doc_id % 10 = 0").select("url", F.when(F.col("doc_id") % 4 == 1, "").otherwise(F.col("snippet")).alias("snippet"), "title", "doc_id", F.col("doc_id").alias("pos"))
    known = a.where("doc_id % 2 = 0").select("url", F.when(F.col("doc_id") % 20 == 0, "").otherwise(F.col("snippet")).alias("snippet"), "title", "doc_id")
    return known, new


@query(f"""WITH {ART}, {_NEW} SELECT coalesce(k.url, n.url) AS url, CASE WHEN k.url IS NULL OR k.snippet = '' THEN coalesce(nullif(n.snippet, ''), k.snippet) ELSE k.snippet END AS snippet, coalesce(k.title, n.title) AS title, coalesce(k.doc_id, n.doc_id) AS doc_id,
  CASE WHEN k.url IS NULL THEN 'added' WHEN k.snippet = '' AND coalesce(n.snippet, '') <> '' THEN 'updated' ELSE 'kept' END AS action FROM known k FULL JOIN new n ON k.url = n.url""")
def upserted(spark, d):
    """J01, T01, D04."""
    return rows.upsert(*_batches(spark, d), "url", ["snippet"])


@query(f"WITH {ART}, {_NEW} SELECT doc_id, url FROM new ANTI JOIN known USING (url)")
def unknown_pages(spark, d):
    """J02."""
    known, new = _batches(spark, d)
    return rows.unknown(new, known, "url").select("doc_id", "url")


@query(f"""WITH {ART}, n AS (SELECT *, {PLAIN.format("title")} AS norm FROM art), known AS (SELECT * FROM n WHERE doc_id % 3 = 0), new AS (SELECT * FROM n WHERE doc_id % 3 > 0 OR doc_id % 12 = 0), k1 AS (SELECT * FROM new ANTI JOIN known USING (url)), k2 AS (SELECT * FROM k1 ANTI JOIN known USING (norm))
SELECT doc_id, url, CASE WHEN published_invalid THEN TIMESTAMP '2024-02-15 12:00:00' ELSE published_at END AS published_at, published_invalid FROM k2""")
def merged_discoveries(spark, d):
    """J03's anti joins: neither url nor normalised title is known; a missing date becomes the run's time. Every article is
    known or comes in, some are both."""
    a = articles(spark, d).withColumn("norm", text.title_plain("title"))
    fresh = rows.unknown(a.where("doc_id % 3 > 0 OR doc_id % 12 = 0"), a.where("doc_id % 3 = 0"), "url", "norm")
    run = F.lit("2024-02-15 12:00:00").cast("timestamp")
    return fresh.select("doc_id", "url", F.when(F.col("published_invalid"), run).otherwise(F.col("published_at")).alias("published_at"), "published_invalid")


_WEEK = "known AS (SELECT * FROM art WHERE doc_id % 3 = 0), new AS (SELECT url, title, CASE WHEN doc_id % 4 = 1 THEN '' ELSE snippet END AS snippet, doc_id FROM art WHERE doc_id % 3 > 0 OR doc_id % 12 = 0), week AS (SELECT url, title, CASE WHEN doc_id % 2 = 0 THEN '' ELSE snippet END AS snippet, doc_id FROM art WHERE doc_id % 7 = 1)"


@query(f"""WITH {ART}, {_WEEK}, t AS (SELECT DISTINCT {PLAIN.format("title")} AS norm FROM known), f AS (SELECT * FROM new ANTI JOIN known USING (url)), g AS (SELECT * FROM f WHERE {PLAIN.format("title")} NOT IN (SELECT norm FROM t WHERE norm <> ''))
SELECT coalesce(w.url, g.url) AS url, coalesce(w.doc_id, g.doc_id) AS doc_id, CASE WHEN w.url IS NULL OR w.snippet = '' THEN coalesce(nullif(g.snippet, ''), w.snippet) ELSE w.snippet END AS snippet,
  CASE WHEN w.url IS NULL THEN 'added' WHEN w.snippet = '' AND coalesce(g.snippet, '') <> '' THEN 'updated' ELSE 'kept' END AS action FROM week w FULL JOIN g ON w.url = g.url""")
def merged_week(spark, d):
    """Selected articles merged into the week's table, after the global table has been asked."""
    a = articles(spark, d).select("url", "title", "snippet", "doc_id")
    new = a.where("doc_id % 3 > 0 OR doc_id % 12 = 0").withColumns({"snippet": F.when(F.col("doc_id") % 4 == 1, "").otherwise(F.col("snippet")), "pos": F.col("doc_id")})
    week = a.where("doc_id % 7 = 1").withColumn("snippet", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("snippet")))
    return rows.merge_week(new, a.where("doc_id % 3 = 0"), week).select("url", "doc_id", "snippet", "action")


@query(f"WITH {ART}, r AS (SELECT url, row_number() OVER (PARTITION BY topic ORDER BY length(body) DESC, doc_id)::INT AS rank FROM art QUALIFY rank <= 40) SELECT doc_id, coalesce(rank, 999)::INT AS rank, rank IS NOT NULL AS ranked FROM art LEFT JOIN r USING (url)")
def ranked_candidates(spark, d):
    """The first 40 of each topic by a stand-in for the scorer, and 999 for the rest."""
    a = articles(spark, d).withColumn("len", F.length("body"))
    ranks = rows.top_k(a.select("url", "topic", "len", "doc_id"), ["topic"], [F.desc("len"), "doc_id"], 40).select("url", "rank")
    return a.join(ranks, "url", "left").select("doc_id", F.coalesce("rank", F.lit(999)).alias("rank"), F.col("rank").isNotNull().alias("ranked"))


@query(f"WITH {ART}, e AS (SELECT left(sha256(url), 16) AS k, title || chr(33) AS t FROM art WHERE doc_id % 3 = 0), x AS (SELECT left(sha256(url), 16) AS k, title AS t FROM art WHERE doc_id % 2 = 0) SELECT doc_id, coalesce(e.t, x.t) AS t, CASE WHEN e.t IS NOT NULL THEN 'enriched' WHEN x.t IS NOT NULL THEN 'extracted' ELSE 'none' END AS origin FROM art LEFT JOIN e ON e.k = left(sha256(url), 16) LEFT JOIN x ON x.k = left(sha256(url), 16)")
def full_texts(spark, d):
    """Keyed by the short hash, the enriched text before the extracted one."""
    from inkstream.functions.keys import sha_short
    from inkstream.sources.readers import by_hash

    a = articles(spark, d).select("doc_id", "url", "title")
    files = lambda x: a.where(x).select(sha_short("url").alias("hash"), "title")
    e = by_hash(a.select("doc_id", "url"), files("doc_id % 3 = 0").select("hash", F.concat("title", F.lit("!")).alias("text"))).withColumnRenamed("text", "e").drop("hash")
    both = by_hash(e, files("doc_id % 2 = 0").withColumnRenamed("title", "text"))
    return both.select("doc_id", F.coalesce("e", "text").alias("t"), F.when(F.col("e").isNotNull(), "enriched").when(F.col("text").isNotNull(), "extracted").otherwise("none").alias("origin"))


@query(f"""WITH {ART}, c AS (SELECT lang, {BARE.format("title")} AS bare, min(doc_id) AS doc_id FROM art GROUP BY 1, 2), t AS (SELECT lang, doc_id, {WORDS.format("bare")} AS w FROM c), p AS (SELECT a.lang, a.doc_id AS a, b.doc_id AS b, len(list_filter(a.w, lambda x: list_contains(b.w, x))) / greatest(len(a.w), len(b.w)) AS overlap FROM t a JOIN t b ON a.lang = b.lang AND a.doc_id < b.doc_id)
SELECT lang, a, b, overlap FROM p WHERE overlap > 0.8""")
def near_title_pairs(spark, d):
    """J14 as a join within languages, over shared rare words, between the titles' representatives."""
    t = articles(spark, d).select("lang", "doc_id", text.title_bare("title").alias("bare")).where("bare <> ''")
    return rows.near_titles(rows.title_classes(t, "lang", "doc_id", "bare"), "lang", "doc_id", "bare")


@query(f"""WITH {ART} SELECT lang, {BARE.format("title")} AS bare, min(doc_id) AS doc_id, count(*) AS members FROM art GROUP BY 1, 2""")
def title_groups(spark, d):
    """Which rows each representative of ``near_title_pairs`` stands for: those of its language and title."""
    t = articles(spark, d).select("lang", "doc_id", text.title_bare("title").alias("bare"))
    return rows.title_classes(t, "lang", "doc_id", "bare")


@query(f"""WITH {ART} SELECT lang, doc_id, min(doc_id) OVER (PARTITION BY lang, {BARE.format("title")}) AS stands_for FROM art""")
def title_members(spark, d):
    """Each row's representative, so that ``near_title_pairs`` tells of rows by their ids."""
    t = articles(spark, d).select("lang", "doc_id", text.title_bare("title").alias("bare"))
    return rows.title_members(t, "lang", "doc_id", "bare")


@query(f"""WITH {ART}, t AS (SELECT doc_id, list_distinct({WORDS.format(PLAIN.format("title"))}) AS w FROM art) SELECT a.doc_id, len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0) AS similarity FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def title_similarity(spark, d):
    """Each title against the next document's."""
    a = articles(spark, d).select("doc_id", "title")
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("title").alias("other"))
    return a.join(b, "doc_id").select("doc_id", rows.jaccard(F.col("title"), F.col("other")).alias("similarity"))


@query("WITH s AS (SELECT DISTINCT source FROM documents) SELECT s.source, t.name FROM s JOIN (VALUES ('src1'), ('src12'), ('the src3 site')) t(name) ON contains(lower(s.source), lower(t.name)) OR contains(lower(t.name), lower(s.source))")
def source_matches(spark, d):
    """Names that contain each other, against a fixed short list."""
    names = spark.createDataFrame([("src1",), ("src12",), ("the src3 site",)], "name string")
    return matching.name_matches(table(spark, d, "documents").select("source"), names).toDF("source", "name")


@query(rf"""WITH {ART}, t AS (SELECT DISTINCT split_part(title, ' ', 1) AS word FROM art), h AS (SELECT DISTINCT regexp_extract(url, '://(?:www\.|m\.)?([^./?#]+)', 1) AS site FROM pages)
SELECT word, site FROM t JOIN h ON word <> '' AND site <> '' AND (contains(lower(word), lower(site)) OR contains(lower(site), lower(word)))""")
def site_words(spark, d):
    """J16 between two growing tables: the first words of titles and the names of sites."""
    words = articles(spark, d).select(F.split_part("title", F.lit(" "), F.lit(1)))
    return matching.name_matches(words, table(spark, d, "pages").select(F.regexp_extract("url", r"://(?:www\.|m\.)?([^./?#]+)", 1))).toDF("word", "site")


@query(f"WITH {ART} SELECT domain, title, doc_id FROM art QUALIFY row_number() OVER (PARTITION BY {PLAIN.format('title')} ORDER BY topic, doc_id) = 1")
def first_of_titles(spark, d):
    """D01."""
    a = articles(spark, d).withColumn("norm", text.title_plain("title"))
    return rows.first_wins(a, ["norm"], ["topic", "doc_id"]).select("domain", "title", "doc_id")


@query(f"WITH {ART}, u AS (SELECT *, {PLAIN.format('title')} AS norm, (source_type = 'discovery')::INT AS prio FROM art) SELECT norm, min(doc_id) OVER (PARTITION BY norm) AS pos, url, prio FROM u QUALIFY row_number() OVER (PARTITION BY norm ORDER BY prio DESC, doc_id DESC) = 1")
def last_of_titles(spark, d):
    """Discovery rows override, at the place where the key first stood."""
    a = articles(spark, d).select(text.title_plain("title").alias("norm"), F.col("doc_id").alias("pos"), "url", (F.col("source_type") == "discovery").cast("int").alias("prio"))
    return rows.last_wins(a, ["norm"], "prio", "pos")


@query(f"WITH {ART} SELECT topic, {PLAIN.format('title')} AS norm, doc_id, min(doc_id) OVER (PARTITION BY topic, {PLAIN.format('title')}) AS first_pos FROM art QUALIFY row_number() OVER (PARTITION BY topic, {PLAIN.format('title')} ORDER BY CASE WHEN published_invalid THEN TIMESTAMP '1970-01-01' ELSE published_at END DESC, doc_id) = 1")
def newest_of_titles(spark, d):
    """D03."""
    a = articles(spark, d).withColumns({"norm": text.title_plain("title"), "published_at": F.when(~F.col("published_invalid"), F.col("published_at"))})
    return rows.newest_wins(a, ["topic", "norm"], "published_at", "doc_id").select("topic", "norm", "doc_id", "first_pos")


@query("""WITH n AS (SELECT o_orderkey, o_orderpriority, o_custkey % 25 AS src, row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 25 ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS m FROM orders), o AS (SELECT *, sum((rn > 3)::INT) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS over FROM n)
SELECT o_orderpriority, o_orderkey, src, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey)::INT AS rank FROM o WHERE rn <= 3 OR over > greatest(m - 50, 0) QUALIFY rank <= 50""")
def diverse_orders(spark, d):
    """W01 in its general form: fifty orders of each priority, three of one customer group."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_custkey") % 25).alias("src"))
    return rows.diverse_top(o, ["o_orderpriority"], "src", "o_orderkey", 50, 3, None).select("o_orderpriority", "o_orderkey", "src", "rank")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_quantity)::INT AS rank FROM lineitem QUALIFY rank <= 3")
def top_lines(spark, d):
    """W08 in its general form: each supplier's three largest lines."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_quantity")
    return rows.top_k(li, ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], 3).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "rank")


@query(f"""WITH {ART}, r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY length(body) DESC, doc_id) AS rank FROM art QUALIFY rank <= 40), d AS (SELECT *, row_number() OVER (PARTITION BY topic, domain ORDER BY rank) AS dr FROM r QUALIFY dr <= 3)
SELECT topic, url, rank::INT AS rank, row_number() OVER (PARTITION BY topic ORDER BY dr > 2, rank)::INT AS place FROM d QUALIFY place <= 20""")
def capped_selection(spark, d):
    """W05 in closed form: domain cap two, relaxed to three."""
    a = rows.top_k(articles(spark, d).withColumn("len", F.length("body")).select("topic", "url", "domain", "len", "doc_id"), ["topic"], [F.desc("len"), "doc_id"], 40)
    return rows.capped_top(a, ["topic"], "domain", "rank", 20).select("topic", "url", "rank", "place")


def _selection(spark, d):
    a = articles(spark, d).withColumn("len", F.length("body"))
    names, _ = text.company_hits(F.col("title"), F.col("body"), F.col("snippet"), lists.LOCAL_COMPANIES[:2])
    a = a.select("topic", "url", "domain", "len", "doc_id", text.title_bare("title").alias("bare_title"), gates.hard_controversy(_x("title", "snippet", "body"), LOCAL).alias("hard"), gates.sponsored_reject("title", "snippet", "body", ["license"]).alias("sponsored"), (F.col("doc_id") % 3 == 0).alias("paywalled"), (F.size(names) > 0).alias("company"))
    ranked = rows.top_k(a, ["topic"], [F.desc("len"), "doc_id"], 40)
    return ranked, rows.select_ranked(ranked, "topic", 7)


_NEAR = "(len(list_filter(c.taken, lambda t: t.title = r.bare OR len(list_filter(string_split(r.bare, ' '), lambda w: list_contains(string_split(t.title, ' '), w))) / greatest(len(string_split(r.bare, ' ')), len(string_split(t.title, ' '))) > 0.8)) > 0)"
_USED = "len(list_filter(c.taken, lambda t: t.domain = r.domain))"
_PICK = f"""(WITH RECURSIVE {ART.strip()}, r AS (SELECT topic, url, domain, {BARE.format("title")} AS bare, doc_id % 3 = 0 AS pay, {any_sql("title || ' ' || snippet || ' ' || body", LOCAL.controversy)} AND NOT {any_sql("title || ' ' || snippet || ' ' || body", LOCAL.policy)} AS hard,
    {any_sql("title || ' ' || snippet || ' ' || body", ["license"])} AS spons, ({" OR ".join(f"contains(lower(title || ' ' || body || ' ' || snippet), '{m}')" for m in lists.LOCAL_COMPANIES[:2])}) AS company, row_number() OVER (PARTITION BY topic ORDER BY length(body) DESC, doc_id)::INT AS rank FROM art QUALIFY rank <= 40),
  m AS (SELECT topic, count(*) AS m FROM r GROUP BY topic),
  walk AS (SELECT topic, m, 2 AS cap, 0 AS i, []::STRUCT(url VARCHAR, title VARCHAR, domain VARCHAR, pay BOOLEAN, rank INT)[] AS taken, []::STRUCT(url VARCHAR, verdict VARCHAR)[] AS told FROM m
    UNION ALL SELECT c.topic, c.m, CASE WHEN c.i = c.m THEN 3 ELSE c.cap END, CASE WHEN c.i = c.m THEN 0 ELSE c.i + 1 END, CASE WHEN c.i < c.m AND why = 'selected' THEN list_append(c.taken, {{'url': r.url, 'title': r.bare, 'domain': r.domain, 'pay': r.pay, 'rank': r.rank}}) ELSE c.taken END,
      CASE WHEN c.i < c.m AND c.cap = 2 AND why IS NOT NULL THEN list_append(c.told, {{'url': r.url, 'verdict': why}}) ELSE c.told END
    FROM walk c LEFT JOIN r ON r.topic = c.topic AND r.rank = c.i + 1, LATERAL (SELECT CASE WHEN len(list_filter(c.taken, lambda t: t.url = r.url)) > 0 THEN NULL WHEN r.hard THEN 'hardControversy' WHEN r.spons THEN 'sponsored' WHEN {_NEAR} THEN 'duplicate' WHEN {_USED} >= c.cap THEN 'domainCap' ELSE 'selected' END AS why)
    WHERE len(c.taken) < 7 AND NOT (c.cap = 3 AND c.i = c.m)),
  ended AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY topic ORDER BY cap DESC, i DESC) = 1),
  walled AS (SELECT topic, x.url, row_number() OVER (PARTITION BY topic ORDER BY x.rank) AS k FROM (SELECT topic, unnest(taken) AS x FROM ended) WHERE x.pay),
  excess AS (SELECT topic, list(url) AS gone, count(*) AS n FROM walled WHERE k > 1 GROUP BY topic),
  spare AS (SELECT r.*, row_number() OVER (PARTITION BY r.topic ORDER BY r.rank) AS k FROM r JOIN ended e USING (topic) JOIN excess x USING (topic)
    WHERE NOT (r.pay OR r.hard OR r.spons) AND len(list_filter(e.taken, lambda t: t.url = r.url AND NOT t.pay)) = 0),
  fill AS (SELECT e.topic, e.cap, 0 AS i, x.n AS n, x.gone, e.taken, list_filter(e.taken, lambda t: NOT list_contains(x.gone, t.url)) AS kept FROM ended e JOIN excess x USING (topic)
    UNION ALL SELECT c.topic, c.cap, c.i + 1, c.n, c.gone, CASE WHEN ok THEN list_append(c.taken, {{'url': r.url, 'title': r.bare, 'domain': r.domain, 'pay': r.pay, 'rank': r.rank}}) ELSE c.taken END,
      CASE WHEN ok THEN list_append(c.kept, {{'url': r.url, 'title': r.bare, 'domain': r.domain, 'pay': r.pay, 'rank': r.rank}}) ELSE c.kept END
    FROM fill c JOIN spare r ON r.topic = c.topic AND r.k = c.i + 1, LATERAL (SELECT len(c.kept) < 7 AND {_USED} < c.cap AND NOT {_NEAR} AS ok) WHERE c.i < c.n),
  filled AS (SELECT topic, kept FROM fill QUALIFY row_number() OVER (PARTITION BY topic ORDER BY i DESC) = 1),
  chosen AS (SELECT e.topic, coalesce(f.kept, e.taken) AS kept, e.told, e.cap FROM ended e LEFT JOIN filled f USING (topic))
  SELECT r.topic, r.url, nullif(list_position([t.url FOR t IN c.kept], r.url), 0)::BIGINT AS place, coalesce([t.verdict FOR t IN c.told IF t.url = r.url][1], 'not_reached') AS verdict, len(c.kept) < 7 OR c.cap = 3 AS relaxed, r.pay, r.company FROM r JOIN chosen c USING (topic))"""


@query(f"SELECT topic, url, place, verdict, relaxed FROM {_PICK}")
def constrained_selection(spark, d):
    """With near-duplicates and the paywall cap; the SQL walks the ranks by recursion."""
    return _selection(spark, d)[1]


_COUNTS = ", ".join(f"count(*) FILTER (verdict = '{r}') AS {r}" for r in ("hardControversy", "sponsored", "duplicate", "domainCap")) + ", bool_or(relaxed) AS relaxed, count(*) FILTER (place IS NOT NULL AND pay) AS paywalled, floor(coalesce(count(*) FILTER (place IS NOT NULL AND pay) * 100.0 / nullif(count(place), 0), 0) + 0.5)::BIGINT AS paywalled_pct, count(*) FILTER (place IS NOT NULL AND company) AS with_company"


@query(f"WITH s AS (SELECT * FROM {_PICK}) SELECT topic, count(*) AS candidates, count(place) AS selected, {_COUNTS} FROM s GROUP BY topic UNION ALL SELECT 'all', count(*), count(place), {_COUNTS} FROM s HAVING count(*) > 0")
def selection_report(spark, d):
    """Of each topic and over all, exclusions by reason, whether the cap was relaxed, the paywalled share
    of the selected ones and how many of these name a company."""
    ranked, s = _selection(spark, d)
    s = s.join(ranked.select("topic", "url", "paywalled", "company"), ["topic", "url"]).withColumn("in", F.col("place").isNotNull())
    n = lambda r: F.count_if(F.col("verdict") == r).alias(r)
    walled = F.count_if(F.col("in") & F.col("paywalled"))
    counts = [F.count(F.lit(1)).alias("candidates"), F.count("place").alias("selected"), n("hardControversy"), n("sponsored"), n("duplicate"), n("domainCap"), F.bool_or("relaxed").alias("relaxed")]
    counts += [walled.alias("paywalled"), text.half_up(text.percent(walled, F.count("place"))).alias("paywalled_pct"), F.count_if(F.col("in") & F.col("company")).alias("with_company")]
    return s.groupBy("topic").agg(*counts).unionByName(s.groupBy(F.lit("all").alias("topic")).agg(*counts))


@query(f"WITH {ART} SELECT topic, doc_id, row_number() OVER (PARTITION BY topic ORDER BY len({WORDS.format('body')}) DESC, doc_id)::INT AS rank FROM art QUALIFY rank <= 20")
def longest_articles(spark, d):
    """W07."""
    a = articles(spark, d).select("topic", "doc_id", text.word_count("body").alias("n"))
    return rows.top_k(a, ["topic"], [F.desc("n"), "doc_id"], 20).select("topic", "doc_id", "rank")


_RANKS = "r AS (SELECT topic, url, (row_number() OVER (PARTITION BY topic ORDER BY url DESC) - 1)::INT AS id, row_number() OVER (PARTITION BY topic ORDER BY url DESC)::INT + (topic = 'Luxury_and_Consumer')::INT AS rank FROM art QUALIFY id < 7)"


def _ranks(spark, d):
    r = rows.top_k(articles(spark, d).select("topic", "url"), ["topic"], [F.desc("url")], 7)
    return r.select("topic", "url", (F.col("rank") - 1).alias("id"), (F.col("rank") + (F.col("topic") == "Luxury_and_Consumer").cast("int")).alias("rank"))


@query(f"WITH {ART}, {_RANKS} SELECT topic, min(rank) = 1 AND max(rank) = count(*) AND count(DISTINCT rank) = count(*) AND count(DISTINCT url) = count(*) AND count(*) = 7 AS valid, count(*) AS n FROM r GROUP BY topic")
def ranking_checks(spark, d):
    """Rankings of which one does not begin at 1."""
    return gates.ranking_valid(_ranks(spark, d).withColumn("candidates", F.lit(100)), ["topic"])


@query(f"""WITH {ART}, {_RANKS}, good AS (SELECT topic FROM r GROUP BY topic HAVING min(rank) = 1 AND max(rank) = count(*)), f AS (SELECT topic, url, row_number() OVER (PARTITION BY topic ORDER BY url)::INT AS rank FROM art QUALIFY rank <= 7)
SELECT topic, url, rank, 'ranked' AS origin FROM r SEMI JOIN good USING (topic) UNION ALL SELECT topic, url, rank, 'fallback' FROM f ANTI JOIN good USING (topic)""")
def reranked(spark, d):
    """Staged ranks where they are valid, else the first by url."""
    a = articles(spark, d).select("topic", "url")
    return rows.reranked(a, _ranks(spark, d), "topic", rows.top_k(a, ["topic"], ["url"], 7))


@query(f"WITH {ART}, k AS (SELECT doc_id, row_number() OVER (ORDER BY topic, url) AS by_topic FROM art QUALIFY by_topic <= 120) SELECT doc_id, by_topic, by_topic IS NOT NULL AS kept FROM art LEFT JOIN k USING (doc_id)")
def search_order(spark, d):
    """Of all rows in order of (topic, url), binary, the first 120 are kept, with their places."""
    from pyspark.sql import Window

    a = articles(spark, d).select("doc_id", "topic", "url")
    first = a.orderBy("topic", "url").limit(120)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("topic", "url"))  # of 120 rows
    first = first.select("doc_id", place.cast("long").alias("by_topic"))
    return a.select("doc_id").join(first, "doc_id", "left").withColumn("kept", F.col("by_topic").isNotNull())


@query(f"""WITH {ART}, c AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'consultancy' WHEN 1 THEN 'platform' ELSE 'discovery' END AS kind, CASE WHEN doc_id % 2 = 0 AND length(body) >= 200 THEN body END AS api, CASE WHEN doc_id % 5 > 0 THEN title END AS page, doc_id % 4 = 0 AS pay, snippet FROM art),
w AS (SELECT *, CASE WHEN kind <> 'discovery' AND length(api) >= 200 THEN 'api' WHEN pay THEN 'snippet' WHEN page IS NOT NULL THEN 'page' ELSE 'none' END AS origin FROM c) SELECT doc_id, origin, md5(CASE origin WHEN 'api' THEN api WHEN 'snippet' THEN snippet WHEN 'page' THEN page END) AS digest FROM w""")
def extraction_routes(spark, d):
    """Services answer with an object of results, or with a bare array."""
    from inkstream.sources.readers import api_text

    item = F.array(F.struct("url", F.lit("").alias("content"), F.col("body").alias("raw_content")))
    answer = F.when(F.col("doc_id") % 4 == 0, F.to_json(F.struct(item.alias("results")))).when(F.col("doc_id") % 2 == 0, F.to_json(item))
    a = articles(spark, d).withColumn("api", api_text(answer))
    kind = F.when(F.col("doc_id") % 3 == 0, "consultancy").when(F.col("doc_id") % 3 == 1, "platform").otherwise("discovery")
    origin, chosen = classify.extraction_source(kind, F.col("api"), F.when(F.col("doc_id") % 5 > 0, F.col("title")), F.col("doc_id") % 4 == 0, F.col("snippet"))
    return a.select("doc_id", origin.alias("origin"), F.md5(chosen).alias("digest"))
