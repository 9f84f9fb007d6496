"""Sources (S01-S14): JSON tables, feeds, pages, listings, staged results of outside services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from inkstream import schemas
from inkstream.functions import dates, text


def json_table(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """A JSON array (or one object) a file, or with ``lines`` a line, so that large files can be split; a missing
    path is an empty table; bad files keep their text in ``_corrupt_record``."""
    try:
        return spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def modified(time: str | Column) -> Column:
    """A file's time, else now; 1970 stands for a time that is not known."""
    t = text.c(time)
    return F.when(t > F.timestamp_seconds(F.lit(0)), t).otherwise(F.current_timestamp())


def walk(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """File names, times and sizes below a folder; contents are not read. A file whose store knows no time counts
    as changed now."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), modified("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def week_folders(files: DataFrame) -> DataFrame:
    """The distinct week labels among the parts of paths, newest first."""
    label = F.filter(F.split("path", "/"), lambda p: F.regexp_replace(p, r"\.json$", "").rlike(r"^\d{4}-W\d{1,2}$"))
    weeks = files.select(F.regexp_replace(F.try_element_at(label, F.lit(-1)), r"\.json$", "").alias("week")).where("week IS NOT NULL").distinct()
    part = lambda k: F.split("week", "-W")[k].cast("int")
    return weeks.orderBy(part(0).desc(), part(1).desc())


def feed_items(payloads: DataFrame) -> DataFrame:
    """Items of RSS payloads (columns feed, status, body), with a reject reason instead of an error.

    A feed that failed, or whose text is no XML, gives one row with the reason; the other feeds are not touched. An
    item without url, title or date is rejected by itself.
    """
    channel = f"channel struct<item: array<struct<{schemas.RSS_ITEM.replace(' string', ': string')}>>>"
    ok = (F.col("status") == 200) & F.ltrim("body").startswith("<")
    parsed = payloads.withColumn("c", F.when(ok, F.from_xml("body", channel, {"mode": "PERMISSIVE"})))
    rows = parsed.select("feed", "status", F.explode_outer("c.channel.item").alias("i"))
    rows = rows.select("feed", "status", text.first_filled("i.link").alias("url"), text.first_filled("i.title").alias("title"), dates.feed_date("i.pubDate").alias("published_at"), text.truncate(text.first_filled("i.description"), 500, 500, "...").alias("snippet"))
    reject = F.when(F.col("status") != 200, F.concat(F.lit("http_"), F.col("status").cast("string"))).when(F.col("url").isNull() & F.col("title").isNull(), "no_items").when(F.col("url").isNull(), "no_url").when(F.col("title").isNull(), "no_title").when(F.col("published_at").isNull(), "no_date")
    return rows.withColumn("reject", reject)


def search_results(staged: DataFrame, per_query: int, total: int, per_topic: bool = False) -> DataFrame:
    """Staged answers of a search service (topic_pos, query_pos, pos, topic, url, title, snippet, ...):
    the first of each url, at most ``per_query`` of a query, ``total`` in topic order (or of each topic)."""
    from inkstream.functions.keys import host, without_www
    from inkstream.operators.rows import first_wins, top_k

    cut = top_k(staged, ["topic_pos", "query_pos"], ["pos"], per_query, "__k").drop("__k")
    first = first_wins(cut, ["url"], ["topic_pos", "query_pos", "pos"])
    order = ["topic_pos", "query_pos", "pos"]
    if per_topic:
        kept = top_k(first, ["topic_pos"], order[1:], total, "__k").drop("__k")
    else:
        kept = first.orderBy(*order).limit(total)
    return kept.withColumns({"snippet": F.substring("snippet", 1, 300), "domain": without_www(host("url"))})


def api_text(body: str | Column) -> Column:
    """The extracted text of a service's answer, an object with results or a bare array; null below 200 characters."""
    b = text.c(body)
    item = "array<struct<url: string, content: string, raw_content: string>>"
    found = F.coalesce(F.from_json(b, schemas.API_RESULT)["results"], F.when(F.ltrim(b).startswith("["), F.from_json(b, item)))
    out = text.first_filled(found[0]["content"], found[0]["raw_content"])
    return F.when(F.length(out) >= 200, out)


def base_queries(spark: SparkSession, path: str, each: int = 12) -> DataFrame:
    """Configured queries by label, which must be exactly so many."""
    raw = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("label", "queries"))
    raw = raw.withColumn("ok", F.assert_true(F.size("queries") == each, F.lit(f"each label needs {each} queries")))
    return raw.where("ok IS NULL").select("label", F.posexplode("queries").alias("pos", "query"))


def by_hash(rows: DataFrame, files: DataFrame, url: str = "url") -> DataFrame:
    """One scan of stored texts (columns hash, text), joined by the short hash of the url."""
    from inkstream.functions.keys import sha_short

    return rows.withColumn("hash", sha_short(url)).join(files.select("hash", "text"), "hash", "left")


def fetched(staged: DataFrame, cache: DataFrame, markers: list[str] | None = None) -> DataFrame:
    """Staged fetches (url, status, body) that the cache lacks, whatever came of them before; status 0
    stands for a network error."""
    from inkstream.operators.gates import paywall_status

    new = staged.join(cache.select("url"), "url", "left_anti")
    return new.withColumns({"paywall": paywall_status(F.col("status"), F.col("body"), markers), "failed": (F.col("status") == 0) | F.col("body").isNull()})


def variant(rows: DataFrame, json: str) -> DataFrame:
    """A column of JSON documents of any shapes as ``doc``, a variant; null where it is no JSON."""
    return rows.withColumn("doc", F.try_parse_json(json)).drop(json)


def selection_report(rows: DataFrame, doc: str = "doc") -> DataFrame:
    """Selection reports of the old, flat shape and of the new one, ``{aggregated, by_topic}``, as the same columns:
    nested, candidates, ranked, selected, excluded (all reasons together), relaxed, topics (their number, 0 in the old
    shape). What a document lacks is 0 or false; a row without a document stays."""
    v = F.col(doc)
    part = lambda path, kind: F.coalesce(F.try_variant_get(v, f"$.aggregated.{path}", kind), F.try_variant_get(v, f"$.{path}", kind))
    count = lambda path: F.coalesce(part(path, "long"), F.lit(0).cast("long"))
    reasons = sum((count(f"exclusion_counts.{r}") for r in ("domainCap", "duplicate", "hardControversy", "sponsored")), F.lit(0).cast("long"))
    topics = F.try_variant_get(v, "$.by_topic", "map<string, variant>")
    return rows.withColumns({
        "nested": F.coalesce(F.try_variant_get(v, "$.aggregated", "variant").isNotNull(), F.lit(False)), "candidates": count("candidate_count"), "ranked": count("ranked_top_k_count"), "selected": count("selected_count"),
        "excluded": reasons, "relaxed": F.coalesce(part("fallback_used.domainCapRelaxed", "boolean"), F.lit(False)), "topics": F.coalesce(F.cardinality(topics), F.lit(0)).cast("long"),
    })
