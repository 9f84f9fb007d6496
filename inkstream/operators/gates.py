"""Filters and gates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions import automaton, lists, text
from inkstream.functions.keys import pattern_any


def valid_item(url: str = "url", title: str = "title", date: str = "published_at") -> Column:
    """P01."""
    filled = lambda x: F.coalesce(F.col(x), F.lit("")) != ""
    return filled(url) & filled(title) & F.col(date).isNotNull()


def window(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Adds ``via`` (published, discovered; null: outside), ``reject`` and the ``published_at`` to go by.

    Discovered rows get a day more at both ends, fall back on the time of discovery, and are out for good if either
    time is over 30 days before the week. All others must lie in the week, ends included.
    """
    day, cutoff = F.expr("INTERVAL 1 DAY"), start - F.expr("INTERVAL 30 DAYS")
    soft = F.col("source_type") == "discovery"
    told = F.col("published_at").isNotNull() & ~F.coalesce("published_invalid", F.lit(False))
    by_date = told & F.col("published_at").between(start - day, end + day)
    by_find = F.col("discovered_at").isNotNull() & F.col("discovered_at").between(start, end)
    reject = (
        F.when(~soft & F.col("published_at").isNull(), "missing_date")
        .when(~soft & ~F.col("published_at").between(start, end), "outside")
        .when(soft & told & (F.col("published_at") < cutoff), "too_old")
        .when(soft & ~by_date & (F.col("discovered_at") < cutoff), "too_old")
        .when(soft & ~by_date & ~by_find, "outside")
    )
    df = df.withColumn("reject", F.when(F.col("source_type").isNull(), F.when(F.col("published_at").isNull(), "missing_date").when(~F.col("published_at").between(start, end), "outside")).otherwise(reject))
    via = F.when(F.col("reject").isNull(), F.when(F.coalesce(soft, F.lit(False)) & ~by_date, "discovered").otherwise("published"))
    df = df.withColumn("via", via)
    return df.withColumn("published_at", F.when(F.col("via") == "discovered", F.col("discovered_at")).otherwise(F.col("published_at")))


@dataclass(frozen=True)
class Markers:
    """The lists that gates look for."""

    sponsored: list[str] = field(default_factory=lambda: lists.LOW_SIGNAL)
    controversy: list[str] = field(default_factory=lambda: lists.CONTROVERSY)
    policy: list[str] = field(default_factory=lambda: lists.POLICY)
    context: list[str] = field(default_factory=lambda: lists.RETAIL_CONTEXT)
    word_boundary: bool = False


    def hits(self, x: Column) -> automaton.Hits:
        """All four lists in one pass over a text; the word boundary is the sponsored and controversy lists' alone."""
        edges = automaton.WHOLE if self.word_boundary else automaton.ANYWHERE
        own = {"sponsored": (self.sponsored, edges), "controversy": (self.controversy, edges)}
        return automaton.Hits(x, own | {"policy": (self.policy, automaton.ANYWHERE), "context": (self.context, automaton.ANYWHERE)})


def controversy(x: Column | automaton.Hits, m: Markers) -> Column:
    """P06: "none", "suspected" (in a retail context) or "controversial"; a policy term clears the text."""
    hits = m.hits(x) if isinstance(x, Column) else x
    return F.when(~hits.any("controversy") | hits.any("policy"), "none").when(hits.any("context"), "suspected").otherwise("controversial")


def hard_controversy(x: Column | automaton.Hits, m: Markers) -> Column:
    """A marker and no policy term."""
    hits = m.hits(x) if isinstance(x, Column) else x
    return hits.any("controversy") & ~hits.any("policy")


def sponsored_reject(title: str, snippet: str, body: str, markers: list[str] | None = None) -> Column:
    """An indicator in title, snippet or body."""
    return text.contains_any(F.concat_ws(" ", title, snippet, body), lists.SPONSORED if markers is None else markers)


def gate(df: DataFrame, start: Column, end: Column, m: Markers) -> DataFrame:
    """Adds eligible, reasons and flags. ``duplicate_of`` holds the url of the first row of the same title."""
    df = window(df, start, end)
    body = F.concat_ws(" ", "title", F.coalesce("snippet", F.lit("")))
    hits = m.hits(body)
    df = df.withColumns({"sponsored": hits.any("sponsored"), "controversy": controversy(hits, m)})
    inside, dup = F.col("reject").isNull(), F.coalesce(F.col("duplicate_of") != F.col("url"), F.lit(False))
    hard = F.col("controversy") == "controversial"
    reasons = F.array_compact(F.array(F.when(~inside, F.col("reject")), F.when(inside & F.col("sponsored"), "sponsored"), F.when(inside & dup, "duplicate"), F.when(inside & ~dup & hard, "controversial"), F.when(inside & ~dup & (F.col("controversy") == "suspected"), "suspected")))
    flags = F.struct((inside & F.col("sponsored")).alias("sponsored"), F.when(inside & dup, F.col("duplicate_of")).alias("duplicate_of"), (inside & ~dup & hard).alias("controversial"), (inside & ~dup & (F.col("controversy") == "suspected")).alias("suspected"))
    return df.withColumns({"eligible": inside & ~dup & ~hard, "reasons": F.when(F.size(reasons) == 0, F.array(F.lit("eligible"))).otherwise(reasons), "flags": flags})


def paywall_status(status: Column, html: Column, markers: list[str] | None = None) -> Column:
    """From the HTTP status or markers in the page; null page: unknown."""
    found = text.contains_any(F.coalesce(html, F.lit("")), markers or lists.PAYWALL_HTML)
    return F.when(status.isin(401, 402, 403) | found, "likely_paywalled").otherwise("unknown")


def paywall_reason(x: Column, patterns: list[str] | None = None) -> Column:
    """P10: the first pattern that the text shows."""
    out = None
    for p in patterns or lists.PAYWALL_TEXT:
        out = F.when(x.rlike(f"(?i){p}"), p) if out is None else out.when(x.rlike(f"(?i){p}"), p)
    return out


def extraction_reject(x: Column, n_words: Column, paywalled: Column, english: Column | None = None, not_article: list[str] | None = None) -> Column:
    """The first reason against an extracted text; null keeps it."""
    english = text.is_english(x) if english is None else english
    return F.when(~english, "non_english").when((n_words < 200) & ~paywalled, "too_short").when(x.rlike(pattern_any(not_article or lists.NOT_ARTICLE)), "not_article")


def podcast_status(x: Column, n_words: Column, paywall: list[str] | None = None, not_article: list[str] | None = None) -> Column:
    """Non-article patterns count in the first fifth only (500 characters at least)."""
    head = F.substring(x, F.lit(1), F.greatest(F.lit(500), F.floor(F.length(x) * 0.2).cast("int")))
    return F.when(x.rlike(pattern_any(paywall or lists.PAYWALL_TEXT[:4])), "paywalled").when(head.rlike(pattern_any(not_article or lists.NOT_ARTICLE)), "extraction_failed").when(n_words < 200, "too_short").otherwise("success")


def item_reject(df: DataFrame) -> Column:
    """The first reason against a page item with columns found, date_text, published_at, url, title, known."""
    empty = lambda x: F.coalesce(F.col(x), F.lit("")) == ""
    return (
        F.when(~F.col("found"), "selector_miss")
        .when(~empty("date_text") & F.col("published_at").isNull(), "invalid_date")
        .when(F.col("published_at").isNull(), "no_date")
        .when(empty("url"), "no_url")
        .when(empty("title"), "no_title")
        .when(F.col("known"), "duplicate")
    )


def ranking_valid(ranks: DataFrame, keys: list[str], most: int = 7) -> DataFrame:
    """For each list, whether its ranks are 1..n, once each, with distinct ids and urls in range.

    Columns: id (index among ``candidates``), url, rank, candidates (their number).
    """
    n, size = F.count(F.lit(1)), F.least(F.lit(most), F.max("candidates"))
    good = (n == size) & (F.min("id") >= 0) & (F.max("id") < F.max("candidates")) & (F.min("rank") == 1) & (F.max("rank") == n)
    good = good & (F.count_distinct("rank") == n) & (F.count_distinct("id") == n) & (F.count_distinct("url") == n)
    return ranks.groupBy(*keys).agg(good.alias("valid"), n.alias("n"))


def known_topic(x: str) -> Column:
    """P17."""
    return F.col(x).isin(*lists.TOPICS)


def week_label_ok(x: str) -> Column:
    """P18."""
    return F.col(x).rlike(r"^\d{4}-W\d{1,2}$")


def shown_n(n: int) -> int:
    """How many articles a view shows."""
    return n if n in (3, 4, 5, 6, 7) else 7


def shown_count(n: Column) -> Column:
    """P19 over a column of wishes."""
    return F.when(n.isin(3, 4, 5, 6, 7), n).otherwise(F.lit(7))


def missing_source(x: str) -> Column:
    """P20."""
    return F.col(x).isNull() | F.col(x).isin("", "undefined")
