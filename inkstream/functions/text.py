"""Scalar text functions as Column expressions (inventory ids F20-F44, F70-F81)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstream.functions import automaton, lists


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def title_plain(x: str | Column) -> Column:
    """lower case, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c(x)), r"\s+", " "))


def title_bare(x: str | Column) -> Column:
    """the same without characters other than ASCII word characters and white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c(x)), r"[^\w\s]", ""), r"\s+", " "))


def whole(word: str) -> str:
    """A pattern for a whole word; letters beyond ASCII do not continue a word."""
    return rf"(?<![A-Za-z0-9_]){re.escape(word)}(?![A-Za-z0-9_])"


def strip(x: str | Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c(x), F.lit(" \t\n\r\f\x0b"))


def contains_any(x: str | Column, markers: list[str], word_boundary: bool = False) -> Column:
    """some marker is a substring, whatever the case; ``word_boundary`` asks for whole words instead."""
    pattern = whole if word_boundary else re.escape
    return F.lower(c(x)).rlike("|".join(pattern(m.lower()) for m in markers))


def _short(keywords: list[str]) -> tuple[list[str], list[str]]:
    """Keywords of up to three characters, which count as whole words only, and the others."""
    low = [k.lower() for k in keywords]
    return [k for k in low if len(k) <= 3], [k for k in low if len(k) > 3]


def keyword_any(x: str | Column, keywords: list[str]) -> Column:
    """some keyword occurs."""
    short, long = _short(keywords)
    return F.lower(c(x)).rlike("|".join([*map(whole, short), *map(re.escape, long)]))


def keyword_count(x: str | Column, keywords: list[str]) -> Column:
    """how many of the keywords occur: whole words up to three characters, else substrings."""
    short, long = _short(keywords)
    low, out = F.lower(c(x)), F.lit(0)
    for hit in [*(low.rlike(whole(k)) for k in short), *(low.contains(k) for k in long)]:
        out = out + hit.cast("int")
    return out


def truncate(x: str | Column, most: int, kept: int | None = None, suffix: str = "") -> Column:
    """texts of over ``most`` characters are cut to ``kept`` and get the suffix."""
    x = c(x)
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most if kept is None else kept), F.lit(suffix))).otherwise(x)


def words(x: str | Column) -> Column:
    return F.filter(F.split(c(x), r"\s+"), lambda w: w != "")


def word_count(x: str | Column) -> Column:
    """non-empty tokens."""
    return F.size(words(x))


def token_count(x: str | Column) -> Column:
    """tokens of a plain split, empty ones included."""
    return F.size(F.split(c(x), r"\s+"))


def ascii_ratio(x: str | Column) -> Column:
    """Share of ASCII characters; null for an empty text."""
    x = c(x)
    return F.length(F.regexp_replace(x, r"[^\x00-\x7F]", "")) / F.nullif(F.length(x), F.lit(0))


def is_english(x: str | Column, least: float = 0.8) -> Column:
    """more than this share is ASCII; an empty text is not English."""
    return F.coalesce(ascii_ratio(x) > least, F.lit(False))


def clean_space(x: str | Column) -> Column:
    """F29."""
    return F.trim(F.regexp_replace(c(x), r"\s+", " "))


def first_filled(*xs: str | Column) -> Column:
    """the first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c(x), F.lit("")) for x in xs])


def longer_title(found: str | Column, given: str | Column) -> Column:
    """the extracted title if it has over ten characters."""
    return F.when(F.length(c(found)) > 10, c(found)).otherwise(c(given))


def headline(x: str | Column) -> Column:
    """F32: punctuation dropped, first ten words."""
    return F.array_join(F.slice(words(F.regexp_replace(c(x), r"[.,!?:;'\"()\[\]{}]", "")), 1, 10), " ")


def first_sentence(x: str | Column) -> Column:
    """The first sentence if it has 21 to 199 characters."""
    s = strip(F.split(c(x), "[.!?]")[0])
    return F.when((F.length(s) > 20) & (F.length(s) < 200), s)


def whats_happening(summary: str | Column, snippet: str | Column, title: str | Column) -> Column:
    """from the summary, else the snippet, else the title."""
    return F.coalesce(first_sentence(summary), first_sentence(snippet), F.concat(F.regexp_replace(c(title), "[.!?]", ""), F.lit(".")))


# Terms of retail, the sentence without a reason, and what is added to a reason without such a term.
RETAIL_TERMS = ["retail", "commerce", "luxury", "ecommerce", "shopping", "customer"]
NO_REASON, IN_RETAIL = "This development affects retail and ecommerce strategies.", " This impacts retail and ecommerce operations."


def why_it_matters(why: str | Column) -> Column:
    """F34."""
    w = F.trim(c(why))
    w = F.when(w.rlike("[.!?]$"), w).otherwise(F.concat(w, F.lit(".")))
    told = contains_any(w, RETAIL_TERMS)
    return F.when(F.coalesce(c(why), F.lit("")) == "", F.lit(NO_REASON)).when(told, w).otherwise(F.concat(w, F.lit(IN_RETAIL)))


def title_words(x: str | Column) -> Column:
    """The tokens of a title that may be keywords."""
    tokens = F.split(F.regexp_replace(F.lower(c(x)), r"[^\w\s]", " "), r"\s+")
    return F.filter(tokens, lambda w: (F.length(w) > 3) & ~w.isin(lists.STOP_WORDS))


def anchors(x: str | Column) -> Column:
    """the first match of each class, as an array of (type, description)."""
    low, found = F.lower(c(x)), []
    for kind, markers in lists.ANCHORS.items():
        out = None
        for term, anchor in markers:
            out = F.when(low.contains(term), anchor) if out is None else out.when(low.contains(term), anchor)
        found.append(F.when(out.isNotNull(), F.struct(F.lit(kind).alias("type"), out.alias("description"))))
    return F.array_compact(F.array(*found))


def clean_themes(x: str | Column) -> Column:
    """trimmed, punctuation dropped, at most five; of over six words six are kept, of under two none."""
    bare = F.transform(c(x), lambda t: F.regexp_replace(F.trim(t), "[.,;:!?]", ""))
    five = F.slice(F.filter(bare, lambda t: F.length(t) > 0), 1, 5)
    cut = F.transform(five, lambda t: F.when(F.size(words(t)) > 6, F.array_join(F.slice(words(t), 1, 6), " ")).otherwise(t))
    return F.filter(cut, lambda t: F.size(F.split(t, r"\s+")) >= 2)


def first_words(x: str | Column, most: int) -> Column:
    """At most so many tokens."""
    tokens = F.split(c(x), r"\s+")
    return F.when(F.size(tokens) > most, F.array_join(F.slice(tokens, 1, most), " ")).otherwise(c(x))


def theme_issues(x: str | Column) -> Column:
    """What is wrong with one theme, as an array of codes."""
    x = c(x)
    w, low = words(x), F.lower(x)
    last = F.element_at(F.split(F.trim(low), r"\s+"), -1)
    specific = F.exists(F.split(x, r"\s+"), lambda t: t.rlike("^[A-Z]") & (F.length(t) > 1)) | contains_any(x, lists.SPECIFIC_TERMS)
    checks = {
        "too_short": F.size(w) < 2,
        "too_long": F.size(w) > 6,
        "banned_phrase": contains_any(x, lists.BANNED_PHRASES),
        "generic": last.isin(lists.GENERIC_ENDINGS) & (F.size(F.split(F.trim(low), r"\s+")) <= 3),
        "not_specific": ~specific,
        "punctuation": x.rlike("[.,;:!?]"),
    }
    return F.array_compact(F.array(*[F.when(check, F.lit(name)) for name, check in checks.items()]))


def sentences(x: str | Column, most: int = 3) -> Column:
    """the first sentences, joined."""
    kept = F.filter(F.split(c(x), "[.!?]+"), lambda s: F.length(strip(s)) > 0)
    return F.concat(F.array_join(F.transform(F.slice(kept, 1, most), lambda s: strip(s)), ". "), F.lit("."))


def strip_label(x: str | Column) -> Column:
    """F39."""
    return F.regexp_replace(c(x), r"(?i)^AI-Generated Summary:\s*", "")


def chunks(x: str | Column, most: int = 4000) -> Column:
    """sentences packed in order into chunks of at most so many characters, a longer sentence alone."""
    x = c(x)
    parts = F.regexp_extract_all(x, F.lit(r"([^.!?]+[.!?]+)"), 1)
    parts = F.when(F.size(parts) == 0, F.array(x)).otherwise(parts)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        full = (F.length(acc["open"]) + F.length(s) > most) & (F.length(acc["open"]) > 0)
        return F.struct(F.when(full, F.array_append(acc["done"], F.trim(acc["open"]))).otherwise(acc["done"]).alias("done"), F.when(full, s).otherwise(F.concat(acc["open"], s)).alias("open"))

    return F.aggregate(parts, start, step, lambda acc: F.when(F.length(F.trim(acc["open"])) > 0, F.array_append(acc["done"], F.trim(acc["open"]))).otherwise(acc["done"]))


def intro_chunks(x: Column) -> Column:
    """indexes of the chunks with the intro."""
    empty = F.array().cast("array<int>")
    return F.when(F.size(x) == 0, empty).when((F.size(x) > 1) & (F.length(x[0]) < 1000), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))


def outro_chunks(x: Column) -> Column:
    """the index of the chunk with the outro."""
    return F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(F.array(F.size(x) - 1))


def topic_key(x: str | Column) -> Column:
    """a topic's key from its key, its name or an alias; null if unknown."""
    pairs = {t: t for t in lists.TOPICS} | lists.TOPIC_ALIASES
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])[c(x)]


def topic_name(x: str | Column) -> Column:
    """the display name of a key."""
    return F.create_map(*[F.lit(v) for kv in lists.TOPIC_NAMES.items() for v in kv])[c(x)]


def percent(n: Column, of: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(n, of) * 100, F.lit(0.0))


def half_up(x: Column) -> Column:
    """halves upwards, also below zero."""
    return F.floor(x + 0.5)


def company_hits(title: Column, text: Column, snippet: Column, companies: list[str]) -> tuple[Column, Column]:
    """names that occur, and their boost: 6 in the title, else 4 in the text, else 2 in the snippet; 10 at most.

    One pass over each of the three, for any number of names.
    """
    found = automaton.named_in([title, text, snippet], companies)
    boost = F.aggregate(found, F.lit(0), lambda sum_, x: sum_ + 6 - 2 * x["field"])
    return F.transform(found, lambda x: x["name"]), F.least(boost, F.lit(10))


def confidence(x: str | Column, default: float = 0.8) -> Column:
    """a number between 0 and 1, else the default."""
    n = F.expr(f"try_cast({x} AS double)") if isinstance(x, str) else x
    return F.when(n.between(0, 1), n).otherwise(F.lit(default))


def penalised(x: Column, issues: Column) -> Column:
    """0.15 less for a result with issues, not below 0."""
    return F.when(issues, F.greatest(F.lit(0.0), x - 0.15)).otherwise(x)


def fenced_json(x: str | Column, schema: str, required: str) -> Column:
    """a JSON object, bare or inside a fence; null if the required field is missing."""
    x = c(x)
    bare, inner = F.from_json(x, schema), F.from_json(F.regexp_extract(x, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), schema)
    return F.when(bare[required].isNotNull(), bare).when(inner[required].isNotNull(), inner)


def first_valid(one: Column, two: Column, one_ok: Column, two_ok: Column) -> tuple[Column, Column]:
    """Which of two staged answers counts, and that one: the first if valid, else a valid retry, else the first."""
    retry = ~one_ok & two.isNotNull() & F.coalesce(two_ok, F.lit(False))
    return F.when(one_ok, "first").when(retry, "retry").otherwise("first_despite_issues"), F.when(retry, two).otherwise(one)


def summary_outcome(snippet: Column, answer: Column) -> Column:
    """Without a snippet there is nothing to sum up; a missing answer is a failure."""
    return F.when(F.coalesce(snippet, F.lit("")) == "", "skipped").when(answer.isNull(), "failed").otherwise("succeeded")


def script_step(one: Column, two: Column, least: int = 2250) -> Column:
    """What becomes of a script by its number of words: taken, written again once, or expanded."""
    return F.when(one >= least, "first").when(two >= least, "retry").otherwise("expand")
