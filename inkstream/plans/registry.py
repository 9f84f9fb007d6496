"""The registry of queries, and the projections of the test tables that they run on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.functions import text
from inkstream.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The week that queries go by: Monday 2024-01-08 to Sunday 2024-01-14, Copenhagen time, as UTC.
START, END = "TIMESTAMP '2024-01-07 23:00:00'", "TIMESTAMP '2024-01-14 22:59:59.999'"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its DuckDB text."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as articles: the first line is the title, the first 500 characters the snippet."""
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "discovery").when(F.col("doc_id") % 3 == 1, "rss").otherwise("page")
    day = F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(doc_id % 40 AS int))")
    return d.select(
        "doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), text.truncate("text", 500, 500, "...").alias("snippet"), F.col("text").alias("body"), "source", "lang",
        F.concat(F.lit("https://www."), "source", F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("url"), F.concat("source", F.lit(".example.com")).alias("domain"),
        day.alias("published_at"), (day + F.expr("make_interval(0, 0, 0, cast(doc_id % 7 AS int) - 3)")).alias("discovered_at"), (F.col("doc_id") % 11 == 0).alias("published_invalid"),
        kind.alias("source_type"), F.element_at(F.array(*[F.lit(t) for t in ("AI_and_Strategy", "Ecommerce_Retail_Tech", "Luxury_and_Consumer", "Jewellery_Industry")]), (F.col("doc_id") % 4 + 1).cast("int")).alias("topic"),
    )


#: The same projection in DuckDB; queries start with it.
ART = """
art AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS snippet, text AS body, source, lang,
  'https://www.' || source || '.example.com/' || doc_id AS url, source || '.example.com' AS domain,
  TIMESTAMP '2024-01-01' + to_days((doc_id % 40)::INT) AS published_at, TIMESTAMP '2024-01-01' + to_days((doc_id % 40)::INT) + to_days((doc_id % 7)::INT - 3) AS discovered_at,
  doc_id % 11 = 0 AS published_invalid, CASE doc_id % 3 WHEN 0 THEN 'discovery' WHEN 1 THEN 'rss' ELSE 'page' END AS source_type,
  ['AI_and_Strategy', 'Ecommerce_Retail_Tech', 'Luxury_and_Consumer', 'Jewellery_Industry'][doc_id % 4 + 1] AS topic
FROM documents)"""


def any_sql(x: str, markers: list[str]) -> str:
    """Some marker is part of the lower-cased text."""
    return "(" + " OR ".join("contains(lower({}), '{}')".format(x, m.lower().replace("'", "''")) for m in markers) + ")"


def keyword_sql(x: str, k: str) -> str:
    k = k.lower()
    return f"regexp_matches(lower({x}), '\\b{k}\\b')" if len(k) <= 3 else "contains(lower({}), '{}')".format(x, k.replace("'", "''"))


def count_sql(x: str, keywords: list[str]) -> str:
    return "(" + " + ".join(f"{keyword_sql(x, k)}::INT" for k in keywords) + ")"


def scored_sql(x: str, keywords: dict[str, list[str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {count_sql(x, ks)} >= {least} THEN '{t}'" for least in (2, 1) for t, ks in keywords.items()) + f" ELSE {default} END"


PLAIN = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
BARE = r"trim(regexp_replace(regexp_replace(lower({}), '[^\w\s]', '', 'g'), '\s+', ' ', 'g'))"
WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')"
