"""Queries over reports, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstream.functions import lists, text
from inkstream.operators import gates, rows
from inkstream.plans.registry import ART, PLAIN, WORDS, articles, query
from inkstream.session import table

_Y = f"y AS (SELECT *, min(doc_id) OVER (PARTITION BY {PLAIN.format('title')}) < doc_id AS dup, n >= 20 AS parsed FROM (SELECT *, len({WORDS.format('body')}) AS n FROM art))"


def _yield(spark, d):
    a = articles(spark, d).select("source", "source_type", "doc_id", text.title_plain("title").alias("norm"), (text.word_count("body") >= 20).alias("parsed"))
    return rows.repeats(a, ["norm"], "doc_id")


def source_yield(df):
    """Counters and percentages of each source."""
    fetched, parsed = F.count(F.lit(1)), F.count_if("parsed")
    new, dup = F.count_if(F.col("parsed") & ~F.col("dup")), F.count_if(F.col("parsed") & F.col("dup"))
    out = df.groupBy("source", "source_type").agg(fetched.alias("fetched"), parsed.alias("parsed"), new.alias("new"), dup.alias("duplicates"))
    return out.withColumns({"yield_pct": F.round(text.percent(F.col("new"), F.col("fetched")), 6), "duplicate_pct": F.round(text.percent(F.col("duplicates"), F.col("parsed")), 6)})


@query(f"""WITH {ART}, {_Y} SELECT source, source_type, count(*) AS fetched, count(*) FILTER (parsed) AS parsed, count(*) FILTER (parsed AND NOT dup) AS new, count(*) FILTER (parsed AND dup) AS duplicates,
  round(coalesce(count(*) FILTER (parsed AND NOT dup) / count(*) * 100, 0), 6) AS yield_pct, round(coalesce(count(*) FILTER (parsed AND dup) / nullif(count(*) FILTER (parsed), 0) * 100, 0), 6) AS duplicate_pct FROM y GROUP BY ALL""")
def yields(spark, d):
    """A01, A11, A12, F70."""
    return source_yield(_yield(spark, d))


@query(f"""WITH {ART}, {_Y}, s AS (SELECT source, source_type, count(*) AS f, count(*) FILTER (parsed AND NOT dup) AS n FROM y GROUP BY ALL) SELECT source_type, count(*) AS sources, sum(f)::BIGINT AS fetched, sum(n)::BIGINT AS new, count(*) FILTER (n = 0) AS empty_sources, round(sum(n) / sum(f) * 100, 6) AS yield_pct FROM s GROUP BY source_type""")
def yield_summary(spark, d):
    """A02, A20."""
    y = source_yield(_yield(spark, d)).groupBy("source_type")
    y = y.agg(F.count(F.lit(1)).alias("sources"), F.sum("fetched").alias("fetched"), F.sum("new").alias("new"), F.count_if(F.col("new") == 0).alias("empty_sources"))
    return y.withColumn("yield_pct", F.round(text.percent(F.col("new"), F.col("fetched")), 6))


_ITEM = "i AS (SELECT page_id, url, page_id % 7 > 0 AS found, CASE page_id % 5 WHEN 0 THEN 'soon' WHEN 1 THEN '' ELSE '2024-01-03' END AS date_text, CASE WHEN page_id % 5 > 1 THEN TIMESTAMP '2024-01-03' END AS p, CASE WHEN page_id % 11 = 0 THEN '' ELSE url END AS u, page_id % 13 = 0 AS known FROM pages), r AS (SELECT *, CASE WHEN NOT found THEN 'selector_miss' WHEN date_text <> '' AND p IS NULL THEN 'invalid_date' WHEN p IS NULL THEN 'no_date' WHEN u = '' THEN 'no_url' WHEN known THEN 'duplicate' END AS reject, regexp_extract(url, '://([^/?#:]+)', 1) AS host FROM i)"


def _items(spark, d):
    from inkstream.functions.keys import host

    p = table(spark, d, "pages").select("page_id", host("url").alias("host"), "url")
    p = p.withColumns({"found": F.col("page_id") % 7 > 0, "date_text": F.expr("CASE page_id % 5 WHEN 0 THEN 'soon' WHEN 1 THEN '' ELSE '2024-01-03' END"), "known": F.col("page_id") % 13 == 0, "url": F.when(F.col("page_id") % 11 == 0, "").otherwise(F.col("url")), "title": F.lit("x")})
    p = p.withColumn("published_at", F.try_to_timestamp("date_text"))
    return p.withColumn("reject", gates.item_reject(p))


@query(f"""WITH {_ITEM} SELECT host, count(*) AS matched, count(*) FILTER (reject IS NULL) AS kept, {", ".join(f"count(*) FILTER (reject = '{r}') AS {r}" for r in ("selector_miss", "invalid_date", "no_date", "no_url", "duplicate"))},
  array_to_string([x::VARCHAR FOR x IN list(page_id ORDER BY page_id) FILTER (reject IS NOT NULL)[1:10]], ',') AS samples FROM r GROUP BY host""")
def page_report(spark, d):
    """Reject counters of each site, and ten failures at most."""
    i = _items(spark, d)
    n = [F.count_if(F.col("reject") == r).alias(r) for r in ("selector_miss", "invalid_date", "no_date", "no_url", "duplicate")]
    counts = i.groupBy("host").agg(F.count(F.lit(1)).alias("matched"), F.count_if(F.col("reject").isNull()).alias("kept"), *n)
    ten = rows.top_k(i.where("reject IS NOT NULL"), ["host"], ["page_id"], 10, "k").groupBy("host").agg(F.array_join(F.transform(F.array_sort(F.collect_list("page_id")), lambda x: x.cast("string")), ",").alias("samples"))
    return counts.join(ten, "host", "left")


@query(f"""WITH {ART}, m(source, category) AS (VALUES {", ".join(f"('src{i}', '{list(lists.TOPIC_NAMES.values())[i % 4]}')" for i in range(16))}), dim(category) AS (VALUES {", ".join(f"('{n}')" for n in lists.TOPIC_NAMES.values())}, ('Podcasts')),
s AS (SELECT source, count(*) AS n FROM art GROUP BY source), r AS (SELECT category, sum(n) AS n, count(*) AS k FROM s JOIN m USING (source) GROUP BY category) SELECT category, coalesce(n, 0)::BIGINT AS found, coalesce(k, 0)::BIGINT AS sources, (SELECT count(*) FROM s ANTI JOIN m USING (source)) AS unmatched FROM dim LEFT JOIN r USING (category)""")
def category_report(spark, d):
    """Sums by category with every category present; sources without one are counted apart."""
    names = list(lists.TOPIC_NAMES.values())
    m = spark.createDataFrame([(f"src{i}", names[i % 4]) for i in range(16)], "source string, category string")
    dim = spark.createDataFrame([(n,) for n in [*names, "Podcasts"]], "category string")
    s = articles(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    r = s.join(m, "source").groupBy("category").agg(F.sum("n").alias("found"), F.count(F.lit(1)).alias("sources"))
    lost = s.join(m, "source", "left_anti").agg(F.count(F.lit(1)).alias("unmatched"))
    return dim.join(r, "category", "left").crossJoin(lost).select("category", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("sources", F.lit(0)).alias("sources"), "unmatched")


@query(r"""WITH h AS (SELECT page_id % 4 AS topic, regexp_replace(regexp_extract(url, '://([^/?#:]+)', 1), 'www\.', '') AS domain FROM pages) SELECT topic, domain, count(*) AS n, CASE WHEN domain LIKE '%.example.net' THEN 'consultancy' WHEN contains(domain, 'example.com') THEN 'platform' ELSE 'discovery' END AS kind, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, domain)::INT AS rank FROM h GROUP BY topic, domain QUALIFY rank <= 5""")
def domain_report(spark, d):
    """The five most frequent domains of each topic, with their class."""
    from inkstream.functions import keys

    domain = keys.without_www(keys.host("url"))
    kind = F.when(keys.is_consultancy(F.col("domain"), ["example.net"]), "consultancy").when(keys.is_platform(F.col("domain"), ["example.com"]), "platform").otherwise("discovery")
    g = table(spark, d, "pages").select((F.col("page_id") % 4).alias("topic"), domain.alias("domain")).groupBy("topic", "domain").agg(F.count(F.lit(1)).alias("n"))
    return rows.top_k(g, ["topic"], [F.desc("n"), "domain"], 5).withColumn("kind", kind)


@query(f"""WITH {ART}, p AS (SELECT topic, CASE WHEN doc_id % 3 = 0 THEN 'discovery' WHEN source IN ('src1', 'src2', 'src3', 'src4') THEN 'pages' ELSE 'rss' END AS pipeline FROM art), g AS (SELECT topic, pipeline, count(*) AS n FROM p GROUP BY ALL)
SELECT topic, pipeline, n, round(n * 100.0 / sum(n) OVER (PARTITION BY topic), 6)::DOUBLE AS pct FROM g""")
def pipeline_shares(spark, d):
    """Where each topic's articles come from."""
    from pyspark.sql import Window

    a = articles(spark, d)
    found = a.where("doc_id % 3 = 0").select("url", F.lit(True).alias("found"))
    p = a.join(found, "url", "left").select("topic", F.when(F.col("found").isNotNull(), "discovery").when(F.col("source").isin("src1", "src2", "src3", "src4"), "pages").otherwise("rss").alias("pipeline"))
    g = p.groupBy("topic", "pipeline").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("topic")), 6))


@query(f"WITH {ART}, s AS (SELECT source, CASE WHEN n < 20 THEN 'failed' WHEN n < 200 THEN NULL ELSE 'success' END AS status, CASE WHEN doc_id % 5 = 0 THEN 'timeout' END AS reason FROM (SELECT *, len({WORDS.format('body')}) AS n FROM art)) SELECT coalesce(reason, status, 'unknown') AS reason, count(*) AS n FROM s GROUP BY 1")
def failure_reasons(spark, d):
    """A16."""
    n = text.word_count("body")
    s = articles(spark, d).select(F.when(n < 20, "failed").when(n >= 200, "success").alias("status"), F.when(F.col("doc_id") % 5 == 0, "timeout").alias("reason"))
    return s.groupBy(F.coalesce("reason", "status", F.lit("unknown")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT doc_id % 4 AS topic, CASE WHEN doc_id % 5 = 0 THEN 'hit' WHEN quality = 1 THEN 'model' ELSE 'fallback' END AS o FROM labels) SELECT topic, count(*) AS total, count(*) FILTER (o = 'hit') AS hits, count(*) FILTER (o <> 'hit') AS misses, count(*) FILTER (o = 'model') AS model_ok, count(*) FILTER (o = 'fallback') AS fallbacks, format('{:.1f}', count(*) / 4.0 + 1e-9) AS per_call FROM l GROUP BY topic""")
def call_counters(spark, d):
    """A17, A18."""
    o = F.when(F.col("doc_id") % 5 == 0, "hit").when(F.col("quality") == 1, "model").otherwise("fallback")
    g = table(spark, d, "labels").select((F.col("doc_id") % 4).alias("topic"), o.alias("o")).groupBy("topic")
    n = lambda c: F.count_if(c)
    return g.agg(F.count(F.lit(1)).alias("total"), n(F.col("o") == "hit").alias("hits"), n(F.col("o") != "hit").alias("misses"), n(F.col("o") == "model").alias("model_ok"), n(F.col("o") == "fallback").alias("fallbacks"), F.format_string("%.1f", F.count(F.lit(1)) / 4.0).alias("per_call"))


@query(f"""WITH {ART}, {_Y}, c AS (SELECT topic, count(*) FILTER (n < 20) AS short, count(*) FILTER (dup) AS dup, count(*) FILTER (published_invalid) AS dates FROM y GROUP BY topic), u AS (SELECT topic, unnest(['short', 'dup', 'dates']) AS reason, unnest([short, dup, dates]) AS n FROM c)
SELECT topic, reason, n, sum(n) OVER (PARTITION BY topic)::BIGINT AS total FROM u QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, reason) <= 2""")
def top_exclusions(spark, d):
    """Each topic's two largest exclusion counters, and the sum of all."""
    from pyspark.sql import Window

    a = articles(spark, d).select("topic", "doc_id", "published_invalid", text.title_plain("title").alias("norm"), text.word_count("body").alias("n"))
    c = rows.repeats(a, ["norm"], "doc_id").groupBy("topic").agg(F.count_if(F.col("n") < 20).alias("short"), F.count_if("dup").alias("dup"), F.count_if("published_invalid").alias("dates"))
    u = c.unpivot(["topic"], ["short", "dup", "dates"], "reason", "n").withColumn("total", F.sum("n").over(Window.partitionBy("topic")))
    return rows.top_k(u, ["topic"], [F.desc("n"), "reason"], 2, "k").drop("k")


@query(f"WITH {ART} SELECT source, count(*) AS n, min(published_at) AS first, max(published_at) AS last, count(*) FILTER (published_at < TIMESTAMP '2024-01-15') AS early FROM art GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_sources(spark, d):
    """The ten sources with most articles."""
    g = articles(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("published_at").alias("first"), F.max("published_at").alias("last"), F.count_if(F.col("published_at") < F.expr("TIMESTAMP '2024-01-15'")).alias("early"))
    return g.orderBy(F.desc("n"), "source").limit(10)


@query(f"WITH {ART}, {_Y}, s AS (SELECT source, count(*) FILTER (parsed AND NOT dup) / count(*) AS y FROM y GROUP BY source), b AS (SELECT 'bottom' AS kind, source FROM s ORDER BY y, source LIMIT 2), t AS (SELECT 'newest' AS kind, url AS source FROM art ORDER BY published_at DESC, doc_id LIMIT 5), l AS (SELECT 'latest' AS kind, max(published_at)::VARCHAR AS source FROM art) FROM b UNION ALL FROM t UNION ALL FROM l")
def extremes(spark, d):
    """The two sources of least yield, the five newest articles, the latest day."""
    y = _yield(spark, d).groupBy("source").agg((F.count_if(F.col("parsed") & ~F.col("dup")) / F.count(F.lit(1))).alias("y"))
    bottom = y.orderBy("y", "source").limit(2).select(F.lit("bottom").alias("kind"), "source")
    newest = articles(spark, d).orderBy(F.desc("published_at"), "doc_id").limit(5).select(F.lit("newest").alias("kind"), F.col("url").alias("source"))
    latest = articles(spark, d).agg(F.date_format(F.max("published_at"), "yyyy-MM-dd HH:mm:ss").alias("source")).select(F.lit("latest").alias("kind"), "source")
    return bottom.unionByName(newest).unionByName(latest)


_ADDED = ", ".join("('{}', '{}')".format(t, q) for t, qs in lists.ADDED_QUERIES.items() for q in qs)


@query(f"""WITH {ART}, b AS (SELECT topic, 'base ' || title AS q FROM art QUALIFY row_number() OVER (PARTITION BY topic ORDER BY doc_id) <= 12), d AS (SELECT topic, 'delta ' || title AS q FROM art QUALIFY row_number() OVER (PARTITION BY topic ORDER BY doc_id DESC) <= 3), a(topic, q) AS (VALUES {_ADDED}),
u AS (FROM b UNION ALL FROM d UNION ALL FROM a) SELECT topic, count(*) AS n, left(sha256(string_agg(q, '|' ORDER BY q)), 16) AS hash FROM u GROUP BY topic""")
def query_sets(spark, d):
    """Each topic's 12 base queries, read from a file of configuration, 3 delta, 2 consultancy and 2
    platform queries, and their hash."""
    from inkstream.session import folder
    from inkstream.sources.readers import base_queries

    a = articles(spark, d).select("topic", "title", "doc_id")
    base = rows.top_k(a, ["topic"], ["doc_id"], 12).select("topic", F.concat(F.lit("base "), "title").alias("q"))
    path, config = folder(spark, "queries"), base.groupBy("topic").agg(F.collect_list("q").alias("q"))
    config.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("topic", "q")))).alias("value")).write.text(path)
    base = base_queries(spark, path).select(F.col("label").alias("topic"), F.col("query").alias("q"))
    delta = rows.top_k(a, ["topic"], [F.desc("doc_id")], 3).select("topic", F.concat(F.lit("delta "), "title").alias("q"))
    added = spark.createDataFrame([(t, q) for t, qs in lists.ADDED_QUERIES.items() for q in qs], "topic string, q string")
    u = base.unionByName(delta).unionByName(added)
    return u.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("q")), "|"), 256), 1, 16).alias("hash"))


_NAMES = ", ".join("('{}', '{}')".format(t, n.replace("'", "''")) for t, ns in (lists.COMPANIES | {"local": lists.LOCAL_COMPANIES}).items() for n in ns)


@query(f"""WITH {ART}, v(tier, name) AS (VALUES {_NAMES}), h AS (SELECT v.tier, v.name, doc_id, CASE WHEN contains(lower(title), name) THEN 6 ELSE 4 END AS points FROM art JOIN v ON contains(lower(title), name) OR contains(lower(body), name))
SELECT tier, name, count(*) AS articles, sum(points)::BIGINT AS points, min(doc_id) AS first_doc FROM h GROUP BY tier, name""")
def company_list(spark, d):
    """The flattened list of names with their tiers, and a few that occur here, as the articles have them."""
    from inkstream.functions import automaton
    from inkstream.operators.classify import company_tier

    names = [n for ns in (*lists.COMPANIES.values(), lists.LOCAL_COMPANIES) for n in ns]
    found = articles(spark, d).select("doc_id", F.explode(automaton.named_in([F.col("title"), F.col("body")], names)).alias("x"))
    tier = F.coalesce(company_tier(F.col("x.name")), F.lit("local"))
    each = found.select(tier.alias("tier"), "x.name", "doc_id", (6 - 2 * F.col("x.field")).cast("long").alias("points"))
    return each.groupBy("tier", "name").agg(F.count(F.lit(1)).alias("articles"), F.sum("points").alias("points"), F.min("doc_id").alias("first_doc"))


@query(f"""WITH {ART}, {_Y}, s AS (SELECT source, count(*) AS f, count(*) FILTER (parsed AND NOT dup) AS n FROM y GROUP BY source) SELECT rpad(left(source, 12), 12, ' ') || lpad(f::VARCHAR, 8, ' ') || lpad(format('{{:.1f}}', n * 100.0 / f) || '%', 9, ' ') AS line FROM s""")
def console_table(spark, d):
    """Lines of fixed width."""
    g = _yield(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("f"), F.count_if(F.col("parsed") & ~F.col("dup")).alias("n"))
    pct = F.concat(F.format_string("%.1f", F.col("n") * 100.0 / F.col("f")), F.lit("%"))
    return g.select(F.concat(F.rpad("source", 12, " "), F.lpad(F.col("f").cast("string"), 8, " "), F.lpad(pct, 9, " ")).alias("line"))


@query(f"WITH {ART} SELECT doc_id, source IS NULL OR source IN ('', 'undefined', 'src3') AS missing, contains(url, 'src1') AS one, regexp_matches('2024-W' || (doc_id % 60), '^\\d{{4}}-W\\d{{1,2}}$') AS label_ok, title <> '' AND url <> '' AND NOT published_invalid AS valid FROM art")
def row_checks(spark, d):
    """P01, P18, P20."""
    a = articles(spark, d).withColumns({"s": F.when(F.col("source") == "src3", "undefined").otherwise(F.col("source")), "label": F.concat(F.lit("2024-W"), (F.col("doc_id") % 60).cast("string")), "published_at": F.when(~F.col("published_invalid"), F.col("published_at"))})
    return a.select("doc_id", gates.missing_source("s").alias("missing"), F.col("url").contains("src1").alias("one"), gates.week_label_ok("label").alias("label_ok"), gates.valid_item().alias("valid"))


@query("SELECT n_name AS nation, r_name AS region, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def nation_report(spark, d):
    """J10 in its general form: a fact table and two small dimensions."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").select("c_nationkey", "c_acctbal").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query(f"""WITH {ART}, t AS (SELECT topic, count(*) AS total FROM art GROUP BY topic), d AS (SELECT DISTINCT topic, {PLAIN.format("title")} AS norm FROM art), k AS (SELECT topic, count(*) AS kept FROM d GROUP BY topic) SELECT topic, kept, (SELECT sum(total) FROM t)::BIGINT AS total FROM k""")
def digest_totals(spark, d):
    """A10: the total before deduplication, each topic's count after it."""
    a = articles(spark, d).select("topic", text.title_plain("title").alias("norm"))
    total = a.agg(F.count(F.lit(1)).alias("total"))
    return a.distinct().groupBy("topic").agg(F.count(F.lit(1)).alias("kept")).crossJoin(total)
