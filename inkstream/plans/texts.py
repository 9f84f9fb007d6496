"""Queries over scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstream.functions import automaton, dates, html, keys, lists, text
from inkstream.operators.rows import top_k
from inkstream.plans.registry import ART, BARE, PLAIN, WORDS, any_sql, articles, count_sql, query
from inkstream.session import table


@query(f"""WITH {ART}, h AS (SELECT doc_id, url, title, list_reduce(list_transform(string_split(url, ''), lambda c: unicode(c)::BIGINT), lambda h, c: (h * 33 + c) & 4294967295, 5381::BIGINT) AS h FROM art)
SELECT doc_id, lower(to_base(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END), 36)) AS short_hash, lower(to_base(('0x' || left(md5(url), 9))::BIGINT, 36)) AS md5_short,
  left(sha256(url), 16) AS sha_short, sha256('2024-W02|' || title || '|' || url || '|base') AS cover_key FROM h""")
def hashes(spark, d):
    """F01, F02, F03, F06."""
    a = articles(spark, d)
    cover = F.sha2(F.concat_ws("|", F.lit("2024-W02"), "title", "url", F.lit("base")), 256)
    return a.select("doc_id", keys.short_hash("url").alias("short_hash"), keys.md5_short("url").alias("md5_short"), keys.sha_short("url").alias("sha_short"), cover.alias("cover_key"))


@query(f"""WITH {ART}, r AS (SELECT source, url, title, strftime(published_at, '%Y-%m-%d') AS date, CASE WHEN length(snippet) > 350 THEN left(snippet, 347) || '...' ELSE snippet END AS snippet FROM art QUALIFY row_number() OVER (PARTITION BY source ORDER BY url) <= 100)
SELECT source, left(md5(list({{'url': url, 'title': title, 'date': date, 'snippet': snippet}} ORDER BY url)::JSON::VARCHAR), 12) AS candidates, left(md5(list(url ORDER BY url)::JSON::VARCHAR), 12) AS urls,
  sha256('2024-W02|' || array_to_string(list(title ORDER BY title), '|') || '|base') AS cover FROM r GROUP BY source""")
def fingerprints(spark, d):
    """Of each source's candidates, which are its first hundred articles by url."""
    a = articles(spark, d).select("source", "url", "title", "snippet", F.date_format("published_at", "yyyy-MM-dd").alias("date"))
    a = top_k(a, ["source"], ["url"], 100)
    return a.groupBy("source").agg(keys.candidates_fingerprint("url", "title", "date", "snippet").alias("candidates"), keys.urls_fingerprint("url").alias("urls"), keys.cover_key(F.lit("2024-W02"), F.collect_list("title"), F.lit("base")).alias("cover"))


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1))"


@query(rf"""WITH h AS (SELECT page_id, url, {_HOST} AS host FROM pages), w AS (SELECT *, regexp_replace(host, 'www\.', '') AS domain FROM h)
SELECT page_id, regexp_extract(lower(split_part(url, '/', 1)), '.*') || '//' || host || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/$', '') || regexp_extract(url, '(\?[^#]*)', 1) AS canonical, domain,
  (domain = 'example.net' OR domain LIKE '%.example.net') AS consultancy, contains(domain, 'example.com') AS platform,
  CASE WHEN domain LIKE '%.example.net' THEN 'consultancy' WHEN contains(domain, 'example.com') THEN 'platform' ELSE 'discovery' END AS source_type FROM w""")
def urls(spark, d):
    """F10, F12, F13, F14, C05, with the corpus's own domains."""
    h = keys.host("url")
    domain = keys.without_www(h)
    consult, platform = keys.is_consultancy(h, ["example.net"]), keys.is_platform(h, ["example.com"])
    kind = F.when(consult, "consultancy").when(platform, "platform").otherwise("discovery")
    return table(spark, d, "pages").select("page_id", keys.canonical("url").alias("canonical"), domain.alias("domain"), consult.alias("consultancy"), platform.alias("platform"), kind.alias("source_type"))


@query(r"""WITH q AS (SELECT page_id, 'tion news site:' || lower(regexp_extract(url, '://([^/?#:]+)', 1)) || ' today' AS query FROM pages)
SELECT page_id, nullif(regexp_extract(query, 'site:([^\s]+)', 1), '') AS site, trim(regexp_replace(query, 'site:[^\s]+\s*', '', 'g')) AS bare FROM q""")
def site_queries(spark, d):
    """F15."""
    q = table(spark, d, "pages").select("page_id", F.concat(F.lit("tion news site:"), keys.host("url"), F.lit(" today")).alias("query"))
    return q.select("page_id", keys.site_of("query").alias("site"), keys.without_site("query").alias("bare"))


@query(rf"""WITH {ART} SELECT doc_id, {PLAIN.format("title")} AS plain, {BARE.format("title")} AS bare, CASE WHEN length(title) > 60 THEN left(title, 57) || '...' ELSE title END AS cut,
  len({WORDS.format("body")})::INT AS n_words, len(string_split_regex(body, '\s+'))::INT AS n_tokens, round(length(regexp_replace(body, '[^\x00-\x7F]', '', 'g')) / nullif(length(body), 0), 6) AS ascii,
  coalesce(length(regexp_replace(body, '[^\x00-\x7F]', '', 'g')) / nullif(length(body), 0) > 0.95, false) AS english, trim(regexp_replace(snippet, '\s+', ' ', 'g')) AS clean,
  CASE WHEN length(title) > 10 THEN title ELSE url END AS shown, round(len({WORDS.format("body")}) / 150)::BIGINT AS minutes FROM art""")
def titles(spark, d):
    """F20, F21, F25-F31, F71, A23."""
    a = articles(spark, d)
    return a.select(
        "doc_id", text.title_plain("title").alias("plain"), text.title_bare("title").alias("bare"), text.truncate("title", 60, 57, "...").alias("cut"), text.word_count("body").alias("n_words"),
        text.token_count("body").alias("n_tokens"), F.round(text.ascii_ratio("body"), 6).alias("ascii"), text.is_english("body", 0.95).alias("english"), text.clean_space("snippet").alias("clean"),
        text.longer_title("title", "url").alias("shown"), text.half_up(text.word_count("body") / 150).alias("minutes"),
    )


@query(f"""WITH {ART}, t AS (SELECT *, title || ' ' || snippet AS x FROM art) SELECT doc_id, {any_sql("x", lists.LOW_SIGNAL)} AS low_signal, {any_sql("x", lists.LOCAL_SPONSORED)} AS sponsored, {any_sql("x || ' ' || body", lists.LOCAL_SPONSORED)} AS sponsored_reject,
  {count_sql("x", lists.AI_KEYWORDS)} AS ai_hits, {count_sql("x", lists.LOCAL_TOPICS["AI_and_Strategy"])} AS local_hits, ({" OR ".join(f"regexp_matches(lower(x), '{chr(92)}b{m}{chr(92)}b')" for m in ("tion", "the"))}) AS whole_word,
  coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE title END, ''), url) AS first_filled FROM t""")
def markers(spark, d):
    """F22, F23, F24, F30; P04 over title and snippet, P05 with the body too."""
    from inkstream.operators import gates

    a = articles(spark, d)
    ai, anywhere = lists.LOCAL_TOPICS["AI_and_Strategy"], automaton.ANYWHERE
    hits = automaton.Hits(F.concat_ws(" ", "title", "snippet"), {"low": (lists.LOW_SIGNAL, anywhere), "sponsored": (lists.LOCAL_SPONSORED, anywhere), "ai": lists.AI_KEYWORDS, "local": ai, "whole": (["tion", "the"], automaton.WHOLE)})
    some = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("title"))
    reject = gates.sponsored_reject("title", "snippet", "body", lists.LOCAL_SPONSORED).alias("sponsored_reject")
    return a.select("doc_id", hits.any("low").alias("low_signal"), hits.any("sponsored").alias("sponsored"), reject, hits.count("ai").alias("ai_hits"), hits.count("local").alias("local_hits"), hits.any("whole").alias("whole_word"), text.first_filled(some, "url").alias("first_filled"))


@query(rf"""WITH {ART}, s AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN body END AS summary, CASE WHEN doc_id % 5 > 0 THEN title END AS why FROM art),
f AS (SELECT *, trim(string_split_regex(summary, '[.!?]')[1], ' ' || chr(9) || chr(10) || chr(13)) AS a, trim(string_split_regex(snippet, '[.!?]')[1], ' ' || chr(9) || chr(10) || chr(13)) AS b, trim(why) AS w FROM s), g AS (SELECT *, CASE WHEN regexp_matches(w, '[.!?]$') THEN w ELSE w || '.' END AS v FROM f)
SELECT doc_id, array_to_string(list_filter(string_split_regex(regexp_replace(title, '[.,!?:;''"()\[\]{{}}]', '', 'g'), '\s+'), lambda x: x <> '')[1:10], ' ') AS headline,
  coalesce(CASE WHEN length(a) > 20 AND length(a) < 200 THEN a END, CASE WHEN length(b) > 20 AND length(b) < 200 THEN b END, regexp_replace(title, '[.!?]', '', 'g') || '.') AS happening,
  CASE WHEN coalesce(why, '') = '' THEN 'This development affects retail and ecommerce strategies.' WHEN {any_sql("v", ["retail", "commerce", "luxury", "ecommerce", "shopping", "customer"])} THEN v ELSE v || ' This impacts retail and ecommerce operations.' END AS matters,
  regexp_replace('ai-generated summary:  ' || title, '^(?i)AI-Generated Summary:\s*', '') AS summary FROM g""")
def headlines(spark, d):
    """F32, F33, F34, F39."""
    a = articles(spark, d).withColumns({"summary": F.expr("CASE WHEN doc_id % 2 = 0 THEN body END"), "why": F.expr("CASE WHEN doc_id % 5 > 0 THEN title END")})
    return a.select("doc_id", text.headline("title").alias("headline"), text.whats_happening("summary", "snippet", "title").alias("happening"), text.why_it_matters("why").alias("matters"), text.strip_label(F.concat(F.lit("ai-generated summary:  "), "title")).alias("summary"))


_STOP = ", ".join(f"'{w}'" for w in sorted(set(lists.STOP_WORDS)))


@query(rf"""WITH {ART}, w AS (SELECT source, doc_id, unnest(string_split_regex(regexp_replace(lower(title), '[^\w\s]', ' ', 'g'), '\s+')) AS word, generate_subscripts(string_split_regex(regexp_replace(lower(title), '[^\w\s]', ' ', 'g'), '\s+'), 1) AS i FROM art),
f AS (SELECT source, word, min((doc_id, i)) AS first FROM w WHERE length(word) > 3 AND word NOT IN ({_STOP}) GROUP BY 1, 2)
SELECT source, word, row_number() OVER (PARTITION BY source ORDER BY first)::INT AS place FROM f QUALIFY place <= 12""")
def title_keywords(spark, d):
    """A source's first twelve distinct title words."""
    w = articles(spark, d).select("source", "doc_id", F.posexplode(text.title_words("title")).alias("i", "word"))
    return top_k(w.groupBy("source", "word").agg(F.min(F.struct("doc_id", "i")).alias("first")), ["source"], ["first"], 12, "place").select("source", "word", "place")


@query("WITH " + ART + ", x AS (SELECT doc_id, lower(title || ' ' || snippet || ' ' || CASE doc_id % 4 WHEN 0 THEN 'shopper in a mall' WHEN 1 THEN 'phone tag' ELSE '' END) AS x FROM art) SELECT doc_id, " + ", ".join(f"CASE {' '.join(f'''WHEN contains(x, '{t}') THEN '{v}' ''' for t, v in ms)} END AS {k}" for k, ms in lists.ANCHORS.items()) + " FROM x")
def visual_anchors(spark, d):
    """F36."""
    more = F.when(F.col("doc_id") % 4 == 0, "shopper in a mall").when(F.col("doc_id") % 4 == 1, "phone tag").otherwise("")
    a = articles(spark, d).select("doc_id", text.anchors(F.concat_ws(" ", "title", "snippet", more)).alias("a"))
    return a.select("doc_id", *[F.expr(f"get(filter(a, x -> x.type = '{k}'), 0).description").alias(k) for k in lists.ANCHORS])


@query(rf"""WITH {ART}, t AS (SELECT doc_id, unnest(list_filter([regexp_replace(trim(x), '[.,;:!?]', '', 'g') FOR x IN string_split(title, ',')], lambda x: length(x) > 0)[1:5]) AS t FROM art),
c AS (SELECT doc_id, CASE WHEN len({WORDS.format("t")}) > 6 THEN array_to_string({WORDS.format("t")}[1:6], ' ') ELSE t END AS theme FROM t)
SELECT doc_id, theme, {any_sql("theme", lists.BANNED_PHRASES)} AS banned, len({WORDS.format("theme")}) < 2 AS too_short,
  NOT (len(list_filter(string_split_regex(theme, '\s+'), lambda w: regexp_matches(w, '^[A-Z]') AND length(w) > 1)) > 0 OR {any_sql("theme", lists.SPECIFIC_TERMS)}) AS not_specific
FROM c WHERE len(string_split_regex(theme, '\s+')) >= 2""")
def themes(spark, d):
    """F37, P16 over the comma-separated parts of titles."""
    a = articles(spark, d).select("doc_id", F.explode(text.clean_themes(F.split("title", ","))).alias("theme")).withColumn("issues", text.theme_issues("theme"))
    has = lambda x: F.array_contains("issues", x)
    return a.select("doc_id", "theme", has("banned_phrase").alias("banned"), has("too_short").alias("too_short"), has("not_specific").alias("not_specific"))


@query(rf"""WITH {ART}, s AS (SELECT doc_id, list_filter(string_split_regex(snippet, '[.!?]+'), lambda s: length(trim(s, ' ' || chr(9) || chr(10) || chr(13))) > 0)[1:3] AS s, string_split_regex(title, '\s+') AS w, title FROM art)
SELECT doc_id, array_to_string([trim(x, ' ' || chr(9) || chr(10) || chr(13)) FOR x IN s], '. ') || '.' AS intro, CASE WHEN len(w) > 22 THEN array_to_string(w[1:22], ' ') ELSE title END AS summary FROM s""")
def intros(spark, d):
    """F37 (summary length), F38, X07: a staged intro is cut to its first sentences."""
    return articles(spark, d).select("doc_id", text.sentences("snippet").alias("intro"), text.first_words("title", 22).alias("summary"))


@query(rf"""WITH RECURSIVE {ART}, s AS (SELECT doc_id, CASE WHEN len(p) = 0 THEN [body] ELSE p END AS parts FROM (SELECT doc_id, body, regexp_extract_all(body, '[^.!?]+[.!?]+') AS p FROM art)),
fold AS (SELECT doc_id, parts, 0 AS i, []::VARCHAR[] AS done, '' AS now FROM s
  UNION ALL SELECT doc_id, parts, i + 1, CASE WHEN length(now) + length(parts[i + 1]) > 400 AND now <> '' THEN list_append(done, trim(now)) ELSE done END,
    CASE WHEN length(now) + length(parts[i + 1]) > 400 AND now <> '' THEN parts[i + 1] ELSE now || parts[i + 1] END FROM fold WHERE i < len(parts)),
c AS (SELECT doc_id, CASE WHEN trim(now) <> '' THEN list_append(done, trim(now)) ELSE done END AS chunks FROM fold WHERE i = len(parts))
SELECT doc_id, len(chunks)::INT AS n, md5(array_to_string(chunks, chr(1))) AS digest, CASE WHEN len(chunks) = 0 THEN 0 WHEN len(chunks) > 1 AND length(chunks[1]) < 1000 THEN 2 ELSE 1 END::INT AS n_intro, CASE WHEN len(chunks) > 0 THEN len(chunks) - 1 END::INT AS outro FROM c""")
def audio_chunks(spark, d):
    """a fold over sentences."""
    a = articles(spark, d).select("doc_id", text.chunks("body", 400).alias("chunks"))
    return a.select("doc_id", F.size("chunks").alias("n"), F.md5(F.array_join("chunks", "\x01")).alias("digest"), F.size(text.intro_chunks(F.col("chunks"))).alias("n_intro"), text.outro_chunks(F.col("chunks"))[0].alias("outro"))


@query(f"WITH {ART} SELECT topic, any_value(CASE topic {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in lists.TOPIC_NAMES.items())} END) AS name, topic AS key, string_agg(DISTINCT source, ', ' ORDER BY source) AS sources FROM art GROUP BY topic")
def topic_names(spark, d):
    """each topic's sources as one string."""
    a = articles(spark, d).select("topic", "source").distinct().withColumn("name", text.topic_name("topic")).withColumn("key", text.topic_key("name"))
    return a.groupBy("topic", "name", "key").agg(F.array_join(F.array_sort(F.collect_list("source")), ", ").alias("sources"))


@query(f"""WITH {ART} SELECT doc_id, '{{"category": "Artificial Intelligence News", "topics": {{"Fashion & Luxury": ["' || source || '", "Artificial Intelligence News"]}}}}' AS migrated FROM art""")
def migrated_names(spark, d):
    """deep renames in JSON texts, by a pandas function."""
    raw = articles(spark, d).select("doc_id", F.to_json(F.struct(F.lit("AI & Strategy").alias("category"), F.create_map(F.lit("Luxury & Consumer"), F.array("source", F.lit("AI & Strategy"))).alias("topics"))).alias("raw"))
    names = {"AI & Strategy": "Artificial Intelligence News", "Luxury & Consumer": "Fashion & Luxury"}
    return raw.select("doc_id", html.renamed(names)("raw").alias("migrated"))


@query(r"SELECT page_id, regexp_matches(ltrim(html), '^(?i)(<\?xml|<rss|<feed|<rdf)') AS xml, len(regexp_extract_all(html, '<p[\s>]'))::INT AS paragraphs, CASE WHEN len(regexp_extract_all(html, '(<item[\s>])')) > 0 THEN len(regexp_extract_all(html, '(<item[\s>])')) ELSE len(regexp_extract_all(html, '(<entry[\s>])')) END::INT AS items FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '<?xml version=\"1.0\"?>' || replace(html, '<p>', '<item>') ELSE html END AS html FROM pages)")
def feed_shape(spark, d):
    """F52, over pages of which every second one is turned into a feed."""
    p = table(spark, d, "pages").withColumn("html", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<?xml version="1.0"?>'), F.replace("html", F.lit("<p>"), F.lit("<item>")))).otherwise(F.col("html")))
    return p.select("page_id", html.looks_like_xml(F.col("html")).alias("xml"), F.size(F.regexp_extract_all("html", F.lit(r"(<p[\s>])"), 1)).alias("paragraphs"), html.count_items(F.col("html")).alias("items"))


_Z = "timezone('Europe/Copenhagen', timezone('UTC', t))"
_M = f"date_trunc('week', {_Z})"


@query(f"""WITH e AS (SELECT event_id, ts + to_days((event_id % 900)::INT) AS t FROM events)
SELECT event_id, timezone('UTC', timezone('Europe/Copenhagen', {_M}::TIMESTAMP)) AS week_start, timezone('UTC', timezone('Europe/Copenhagen', {_M}::TIMESTAMP + INTERVAL 7 DAY - INTERVAL 1 MILLISECOND)) AS week_end,
  strftime({_Z}, '%G-W%V') AS label, year({_M})::VARCHAR || '-W' || strftime({_Z}, '%V') AS calendar_label FROM e""")
def local_weeks(spark, d):
    """Weeks of Copenhagen time across the change to summer time and the turn of years."""
    e = table(spark, d, "events").select("event_id", F.expr("ts + make_interval(0, 0, 0, cast(event_id % 900 AS int))").alias("t"))
    t = F.col("t")
    return e.select("event_id", dates.week_start(t).alias("week_start"), dates.week_end(t).alias("week_end"), dates.week_label(t).alias("label"), dates.week_label(t, calendar_year=True).alias("calendar_label"))


@query("""WITH l AS (SELECT DISTINCT strftime(ts + to_days((event_id % 900)::INT), '%G-W%V') AS label FROM events), p AS (SELECT label, left(label, 4)::INT AS y, right(label, 2)::INT AS w FROM l)
SELECT label, CASE WHEN w > 1 THEN y::VARCHAR || '-W' || lpad((w - 1)::VARCHAR, 2, '0') ELSE (y - 1)::VARCHAR || '-W52' END AS previous, 'Week ' || w || ', ' || y AS shown, lag(label) OVER (ORDER BY y, w) AS prev_week, lead(label) OVER (ORDER BY y, w) AS next_week FROM p""")
def week_navigation(spark, d):
    """Labels among the parts of paths, in order, with their neighbours."""
    from pyspark.sql import Window

    from inkstream.sources.readers import week_folders

    label = dates.week_label(F.expr("ts + make_interval(0, 0, 0, cast(event_id % 900 AS int))"), "UTC")
    files = table(spark, d, "events").select(F.explode(F.array(F.concat(F.lit("weeks/"), label, F.lit("/digest.json")), F.lit("weeks/notes/digest.json"))).alias("path")).distinct()
    e = week_folders(files).select(F.col("week").alias("label"))
    e = e.withColumns({"y": F.substring("label", 1, 4).cast("int"), "w": F.substring("label", 7, 2).cast("int")})
    order = Window.partitionBy(F.lit(1)).orderBy("y", "w")  # one row a week: a few thousand in all
    return e.select("label", dates.previous_label("label").alias("previous"), dates.shown_label("label").alias("shown"), F.lag("label").over(order).alias("prev_week"), F.lead("label").over(order).alias("next_week"))


_NOW = "TIMESTAMP '2024-02-15 12:00:00'"


@query(f"""WITH s AS (SELECT doc_id, n_chars % 50 AS n, CASE doc_id % 6 WHEN 0 THEN (n_chars % 50) || ' hours ago' WHEN 1 THEN (n_chars % 50) || ' Weeks ago' WHEN 2 THEN (n_chars % 50) || ' days' WHEN 3 THEN (1 + n_chars % 28) || ' March 2024' WHEN 4 THEN '2024-01-' || lpad((1 + n_chars % 40)::VARCHAR, 2, '0') ELSE 'soon' END AS date_text, CASE WHEN doc_id % 4 < 3 THEN 'RELATIVE' ELSE 'none' END AS hint FROM documents)
SELECT doc_id, CASE WHEN date_text LIKE '%hours ago' THEN CASE WHEN hint = 'RELATIVE' THEN {_NOW} - to_hours(n) END WHEN date_text LIKE '%Weeks ago' THEN CASE WHEN hint = 'RELATIVE' THEN {_NOW} - to_weeks(n::INT) END WHEN date_text LIKE '%days' THEN CASE WHEN hint = 'RELATIVE' THEN {_NOW} - to_days(n::INT) END
  WHEN date_text LIKE '%March%' THEN CASE WHEN hint = 'RELATIVE' THEN try_strptime(date_text, '%d %B %Y') END ELSE try_cast(date_text AS TIMESTAMP) END AS found FROM s""")
def item_dates(spark, d):
    """F64, over made-up date texts of several shapes."""
    n = F.col("n_chars") % 50
    shape = F.when(F.col("doc_id") % 6 == 0, F.concat(n.cast("string"), F.lit(" hours ago"))).when(F.col("doc_id") % 6 == 1, F.concat(n.cast("string"), F.lit(" Weeks ago"))).when(F.col("doc_id") % 6 == 2, F.concat(n.cast("string"), F.lit(" days"))).when(F.col("doc_id") % 6 == 3, F.concat((1 + F.col("n_chars") % 28).cast("string"), F.lit(" March 2024"))).when(F.col("doc_id") % 6 == 4, F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("n_chars") % 40).cast("string"), 2, "0"))).otherwise("soon")
    s = table(spark, d, "documents").select("doc_id", shape.alias("date_text"), F.when(F.col("doc_id") % 4 < 3, "RELATIVE").otherwise("none").alias("hint"))
    return s.select("doc_id", dates.best_date("date_text", "hint", F.expr(_NOW)).alias("found"))


@query("""WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN (2010 + n_chars % 20) || '-05-17' WHEN 1 THEN '' WHEN 2 THEN 'never' ELSE '2024-02-30' END AS x, 'Mon, ' || lpad((1 + n_chars % 28)::VARCHAR, 2, '0') || ' Jan 2024 10:20:30 +0100' AS rfc, n_chars FROM documents)
SELECT doc_id, CASE WHEN year(try_cast(x AS TIMESTAMP)) BETWEEN 2015 AND 2025 THEN try_cast(x AS TIMESTAMP) END AS valid, make_timestamp(2024, 1, 1 + n_chars % 28, 9, 20, 30) AS feed FROM s""")
def checked_dates(spark, d):
    """F65, F66."""
    x = F.when(F.col("doc_id") % 4 == 0, F.concat((2010 + F.col("n_chars") % 20).cast("string"), F.lit("-05-17"))).when(F.col("doc_id") % 4 == 1, "").when(F.col("doc_id") % 4 == 2, "never").otherwise("2024-02-30")
    rfc = F.concat(F.lit("Mon, "), F.lpad((1 + F.col("n_chars") % 28).cast("string"), 2, "0"), F.lit(" Jan 2024 10:20:30 +0100"))
    return table(spark, d, "documents").select("doc_id", dates.valid_date(x, 2024).alias("valid"), dates.feed_date(rfc).alias("feed"))


@query("""WITH o AS (SELECT DISTINCT date_trunc('week', o_orderdate) AS a FROM orders), b AS (SELECT a, a + INTERVAL 6 DAY AS b FROM o), c AS (SELECT *, day(b)::VARCHAR || CASE WHEN day(b) IN (11, 12, 13) THEN 'th' WHEN day(b) % 10 = 1 THEN 'st' WHEN day(b) % 10 = 2 THEN 'nd' WHEN day(b) % 10 = 3 THEN 'rd' ELSE 'th' END || ' ' || year(b) AS last FROM b)
SELECT strftime(a, '%Y-%m-%d') AS day, strftime(a, '%b %-d') AS short, strftime(a, '%b %-d, %Y %H:%M') AS long, CASE WHEN month(a) = month(b) THEN strftime(a, '%b %-d') || '-' || last ELSE strftime(a, '%b %-d') || ' - ' || strftime(b, '%b ') || last END AS span FROM c""")
def shown_dates(spark, d):
    """F67."""
    o = table(spark, d, "orders").select(F.date_trunc("week", "o_orderdate").alias("a")).distinct().withColumn("b", F.col("a") + F.expr("INTERVAL 6 DAYS"))
    return o.select(F.date_format("a", "yyyy-MM-dd").alias("day"), F.date_format("a", "MMM d").alias("short"), F.date_format("a", "MMM d, yyyy HH:mm").alias("long"), dates.shown_range(F.col("a"), F.col("b")).alias("span"))


_C = lists.LOCAL_COMPANIES


@query(f"""WITH {ART}, h AS (SELECT doc_id, {", ".join(f"CASE WHEN contains(lower(title), '{c}') THEN 6 WHEN contains(lower(body), '{c}') THEN 4 ELSE 0 END AS c{i}" for i, c in enumerate(_C))} FROM art)
SELECT doc_id, array_to_string(list_filter([{", ".join(f"CASE WHEN c{i} > 0 THEN '{c}' END" for i, c in enumerate(_C))}], lambda x: x IS NOT NULL), '|') AS names, least({" + ".join(f"c{i}" for i in range(len(_C)))}, 10) AS boost FROM h""")
def company_boost(spark, d):
    """F72, with names that occur in the corpus."""
    names, boost = text.company_hits(F.col("title"), F.col("body"), F.lit(None).cast("string"), _C)
    return articles(spark, d).select("doc_id", F.array_join(names, "|").alias("names"), boost.alias("boost"))


@query("""WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '0.' || n_chars % 100 WHEN 1 THEN 'high' WHEN 2 THEN '7' ELSE NULL END AS x, CASE WHEN doc_id % 5 = 0 THEN 'Politics' ELSE 'AI_and_Strategy' END AS t FROM documents), c AS (SELECT *, CASE WHEN try_cast(x AS DOUBLE) BETWEEN 0 AND 1 THEN try_cast(x AS DOUBLE) ELSE 0.8 END AS c FROM s)
SELECT doc_id, c AS confidence, round(CASE WHEN doc_id % 3 = 0 THEN greatest(0, c - 0.15) ELSE c END, 9) AS penalised, t IN ('AI_and_Strategy', 'Ecommerce_Retail_Tech', 'Luxury_and_Consumer', 'Jewellery_Industry') AS known FROM c""")
def confidences(spark, d):
    """F73, P17."""
    from inkstream.operators.gates import known_topic

    x = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("0."), (F.col("n_chars") % 100).cast("string"))).when(F.col("doc_id") % 4 == 1, "high").when(F.col("doc_id") % 4 == 2, "7")
    s = table(spark, d, "documents").select("doc_id", x.alias("x"), F.when(F.col("doc_id") % 5 == 0, "Politics").otherwise("AI_and_Strategy").alias("t"))
    c = text.confidence("x")
    return s.select("doc_id", c.alias("confidence"), F.round(text.penalised(c, F.col("doc_id") % 3 == 0), 9).alias("penalised"), known_topic("t").alias("known"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN source END AS category, CASE WHEN doc_id % 3 < 2 THEN n_chars % 100 END::INT AS score, '{"id":' || doc_id || ',"source":"' || source || '"}' AS json FROM documents""")
def model_json(spark, d):
    """bare JSON, JSON in a fence, and broken answers."""
    docs = table(spark, d, "documents")
    inner = F.to_json(F.struct(F.col("source").alias("category"), (F.col("n_chars") % 100).alias("score")))
    raw = F.when(F.col("doc_id") % 3 == 0, inner).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Sure:\n```json\n"), inner, F.lit("\n```\n"))).otherwise("no {json")
    got = text.fenced_json("raw", "category string, score int", "category")
    return docs.select("doc_id", "source", raw.alias("raw")).select("doc_id", got["category"].alias("category"), got["score"].alias("score"), F.to_json(F.struct(F.col("doc_id").alias("id"), "source")).alias("json"))


_DECODED = "replace(replace(replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')"


def _plain_sql(x: str) -> str:
    """The text of a piece of markup: comments, scripts and tags dropped, entities decoded."""
    return _DECODED.format(rf"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->|<script>.*?</script>|<style>.*?</style>', '', 'g'), '<[^>]*>', '', 'g')")


@query(rf"""WITH p AS (SELECT page_id, {_plain_sql("regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1)")} AS a, {_plain_sql("regexp_extract(html, '(?s)<body>(.*?)(?:</body>|$)', 1)")} AS b, {_DECODED.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS t FROM pages),
c AS (SELECT page_id, trim(regexp_replace(CASE WHEN length(a) > 500 THEN a ELSE b END, '\s+', ' ', 'g')) AS x, trim(t, ' ' || chr(9) || chr(10) || chr(13)) AS title FROM p)
SELECT page_id, md5(x) AS text_md5, length(x)::INT AS n_chars, title, NULL::VARCHAR AS author, NULL::VARCHAR AS date FROM c""")
def page_articles(spark, d):
    """Text, title, author and date of every page, by a parser."""
    a = html.extract_article("html")
    p = table(spark, d, "pages").select("page_id", a.alias("a"))
    return p.select("page_id", F.md5("a.text").alias("text_md5"), F.length("a.text").alias("n_chars"), "a.title", "a.author", "a.date")


@query(rf"""WITH n AS (SELECT page_id, url, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages), l AS (SELECT page_id, url, unnest(regexp_extract_all(nav, '<li><a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(nav, '<li><a href="[^"]*">([^<]*)</a>', 1)) AS t FROM n)
SELECT page_id, trim(regexp_replace({_DECODED.format("t")}, '\s+', ' ', 'g')) AS title, regexp_extract(url, '^[a-z]+://[^/?#]+') || {_DECODED.format("href")} AS url, NULL::VARCHAR AS date_text FROM l""")
def page_links(spark, d):
    """Items by selectors, with absolute urls; a fallback set for pages where the first finds none."""
    find = html.items(".teaser", "a", "h2", "time", fallback=("nav li", "a", None, None))
    p = table(spark, d, "pages").select("page_id", F.explode(find("html", "url")).alias("i"))
    return p.select("page_id", "i.title", "i.url", "i.date_text")
