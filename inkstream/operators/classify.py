"""Topic classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions import automaton, lists, text

#: Topic -> keywords, in the order in which topics win.
KEYWORDS = {"Jewellery_Industry": lists.JEWELLERY_KEYWORDS, "Luxury_and_Consumer": lists.LUXURY_KEYWORDS, "Ecommerce_Retail_Tech": lists.ECOMMERCE_KEYWORDS, "AI_and_Strategy": lists.AI_KEYWORDS}
DEFAULT = "Ecommerce_Retail_Tech"


def scored(hits: automaton.Hits, topics: list[str], fallback: Column | None = None) -> Column:
    """The keyword part of C01: a topic with two hits or more, else one with a hit, in the topics' order.

    ``hits`` counts each topic's list under its name. A topic's hits, two at most, and its place make one number; the
    greatest names the topic.
    """
    n, last = len(topics), F.lit(DEFAULT) if fallback is None else fallback
    marks = [F.least(hits.count(t), F.lit(2)) * n + (n - 1 - i) for i, t in enumerate(topics)]
    best = F.greatest(*marks) if n > 1 else marks[0]
    names = [F.lit(t) for t in reversed(topics)]
    return F.coalesce(F.element_at(F.array(*[F.lit(None).cast("string")] * n, *names, *names), best + 1), last)


def topic(title: Column, source: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """By the source's name, else by keywords in title and source, else by specific terms.

    All lists are looked for in one pass.
    """
    keywords, s = keywords or KEYWORDS, F.coalesce(source, F.lit(""))
    hits = automaton.Hits(F.concat_ws(" ", title, source), keywords | {"strong": lists.STRONG_AI, "specific": lists.SPECIFIC_LUXURY})
    from_shop = F.when(hits.any("strong"), "AI_and_Strategy").otherwise(DEFAULT)
    rest = F.when(hits.any("specific"), "Luxury_and_Consumer").otherwise(DEFAULT)
    return (
        F.when(text.contains_any(s, lists.JEWELLERY_SOURCES), "Jewellery_Industry")
        .when(text.contains_any(s, lists.ECOMMERCE_SOURCES), from_shop)
        .when(text.contains_any(s, lists.LUXURY_SOURCES), "Luxury_and_Consumer")
        .when(text.contains_any(s, lists.AI_SOURCES), "AI_and_Strategy")
        .otherwise(scored(hits, list(keywords), rest))
    )


def discovery_topic(x: Column, terms: dict[str, list[str]] | None = None) -> Column:
    """The first topic with a term in the text."""
    terms = terms or lists.DISCOVERY_TERMS
    hits = automaton.Hits(x, terms, automaton.ANYWHERE)
    return F.coalesce(*[F.when(hits.any(t), t) for t in terms], F.lit(DEFAULT))


def support(hits: automaton.Hits, chosen: Column, topics: list[str] | None = None) -> Column:
    """hits among the chosen topic's short list."""
    return F.coalesce(*[F.when(chosen == t, hits.count(t)) for t in topics or lists.SUPPORT], F.lit(0))


def hybrid(df: DataFrame, version: str, rule: Column, hits: Column, least: float = 0.55) -> DataFrame:
    """Cached result, else the model's, else the rules'.

    Columns cached_topic, cached_version, model_topic, model_confidence (null: the model failed), hint. Adds topic,
    confidence, and origin (cache, model, low_confidence, fallback).
    """
    df = df.withColumns({"rule_topic": rule, "hits": hits})
    hint = F.create_map(*[F.lit(v) for kv in lists.HINTS.items() for v in kv])[F.col("hint")]
    cached = F.col("cached_topic").isNotNull() & (F.col("cached_version") == version)
    unsure = F.col("model_confidence") < least
    origin = F.when(cached, "cache").when(F.col("model_topic").isNull(), "fallback").when(unsure, "low_confidence").otherwise("model")
    df = df.withColumn("origin", origin)
    chosen = F.when(F.col("origin") == "cache", F.col("cached_topic")).when(F.col("origin") == "model", F.col("model_topic")).when((F.col("origin") == "low_confidence") & (F.col("hits") < 2) & hint.isNotNull(), hint).otherwise(F.col("rule_topic"))
    weak = F.when(F.col("hits") >= 2, 0.4).when(F.col("hits") == 1, 0.3).otherwise(0.2)
    trust = F.when(F.col("origin") == "cache", F.col("cached_confidence")).when(F.col("origin") == "model", F.col("model_confidence")).when(F.col("origin") == "low_confidence", 0.3).otherwise(weak)
    return df.withColumns({"topic": chosen, "confidence": trust})


def company_tier(x: Column) -> Column:
    """C04."""
    out = None
    for tier, names in lists.COMPANIES.items():
        out = F.when(F.lower(x).isin(names), tier) if out is None else out.when(F.lower(x).isin(names), tier)
    return out


def extraction_source(kind: Column, api: Column, page: Column, paywalled: Column, snippet: Column) -> tuple[Column, Column]:
    """Which text is taken, and from where: the API first for consultancies and platforms, then the page, and the
    snippet of a paywalled page."""
    first = kind.isin("consultancy", "platform") & (F.length(api) >= 200)
    where = F.when(first, "api").when(paywalled, "snippet").when(page.isNotNull(), "page").otherwise("none")
    return where, F.when(where == "api", api).when(where == "snippet", snippet).when(where == "page", page)
