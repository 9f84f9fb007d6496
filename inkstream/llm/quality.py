"""Operator 9: quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a condition that rejects a document. On a small sample, each rule's cost (seconds a row, what a job without
the rule takes subtracted) and its selectivity (share that it rejects) are estimated, and the rules are ordered by
rejection per cost. They become one CASE, which evaluates a rule only where all earlier ones passed; features that only
one rule needs, such as the hashed windows, stay inside its branch. The order changes the cost, never the verdict, since
the verdict is the conjunction of all rules.

Results: a null or empty text has no words and is rejected as too short; texts of any length are read whole; rows that
repeat get the same verdict each; other columns pass through, whatever their names.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.llm import columns
from inkstream.session import discard, materialise

#: Rows of the sample on which rules are ordered, at most, and the share of rows it is drawn from; how often a job
#: evaluates each row, and how many jobs a rule gets, of which the fastest counts.
SAMPLE_ROWS, SAMPLE_SHARE, TURNS, JOBS = 200, 0.2, 6, 2
SEPARATOR = r"[\x20\x09-\x0D]+"
_BLANK = " \t\n\x0b\f\r"
_W = "__quality_"


@dataclass(frozen=True)
class Limits:
    """Thresholds: a document is rejected below or above them (shares in hundredths)."""

    words: int = 50
    repeated: int = 50
    symbols: int = 10
    same_lines: int = 30
    shortest_word: int = 2
    longest_word: int = 14
    capitals: int = 40


def staged(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the words of each text, which several features share."""
    bare = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(_BLANK))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SEPARATOR))
    # the row number keeps filters above these columns: below them, every use would split the text again
    return docs.withColumns({f"{_W}words": words, f"{_W}row": F.monotonically_increasing_id()})


def n_words() -> Column:
    return F.size(f"{_W}words").cast("long")


def word_chars() -> Column:
    """Code points in words."""
    return F.length(F.array_join(f"{_W}words", "")).cast("long")


def n_symbols(text: str = "text") -> Column:
    """Characters among # * $ % & | < >."""
    return (F.size(F.split(F.coalesce(F.col(text), F.lit("")), r"[#*$%&|<>]")) - 1).cast("long")


def _lines(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: str = "text") -> Column:
    """Lines with a word that equal an earlier line."""
    lines = _lines(text)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words() -> Column:
    """Words in 3-word windows found twice or more.

    Texts whose hashed windows are all distinct have none. Of the others, places are sorted by hash, and only those whose
    hash stands beside an equal one take their words along; these are sorted by hash and words, so equal windows
    (compared word by word) stand side by side. The windows are made here, once, so a text that an earlier rule rejects
    has none.
    """
    w = f"{_W}words"
    windows = f"CASE WHEN size({w}) >= 3 THEN transform(sequence(0, size({w}) - 3), i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2])) ELSE cast(array() AS array<bigint>) END"
    beside = "at.h <=> get(byhash, j - 1).h OR at.h <=> get(byhash, j + 1).h"
    twice = f"transform(array(sort_array(transform(hashed, (x, i) -> named_struct('h', x, 'i', i)))), byhash -> filter(byhash, (at, j) -> {beside}))[0]"
    same = " AND ".join(f"at.{c} <=> {{0}}.{c}" for c in "habc")
    marked = f"""transform(sorted, (at, j) -> CASE WHEN ({same.format("get(sorted, j - 1)")}) OR ({same.format("get(sorted, j + 1)")}) THEN at.i END)"""
    rows = f"sort_array(transform({twice}, x -> named_struct('h', x.h, 'a', {w}[x.i], 'b', {w}[x.i + 1], 'c', {w}[x.i + 2], 'i', x.i)))"
    places = f"transform(array({rows}), sorted -> sort_array(array_compact({marked})))[0]"
    covered = f"transform(array({places}), at -> aggregate(transform(at, (x, j) -> least(3, coalesce(get(at, j + 1), x + 3) - x)), 0, (a, b) -> a + b))[0]"
    return F.expr(f"transform(array({windows}), hashed -> CASE WHEN size(array_distinct(hashed)) = size(hashed) THEN 0L ELSE cast({covered} AS bigint) END)[0]")


def features() -> dict[str, Column]:
    """The base features, by name."""
    return {"n_words": n_words(), "word_chars": word_chars(), "n_symbols": n_symbols(), "n_dup_lines": n_dup_lines(), "n_repeat_words": n_repeat_words()}


def rules(limits: Limits, text: str = "text", known: bool = False) -> dict[str, Column]:
    """The rejecting condition of each rule. ``known``: the base features are columns already."""
    get = (lambda name, _: F.col(name)) if known else (lambda _, expression: expression)
    words, chars = get("n_words", n_words()), get("word_chars", word_chars())
    symbols, same = get("n_symbols", n_symbols(text)), get("n_dup_lines", n_dup_lines(text))
    capitals = F.size(F.split(F.coalesce(F.col(text), F.lit("")), "[A-Z]")) - 1
    return {
        "too_few_words": words < limits.words,
        "repeated_windows": get("n_repeat_words", n_repeat_words()) * 100 > words * limits.repeated,
        "symbols": symbols * 100 > chars * limits.symbols,
        "same_lines": same * 100 > F.size(_lines(text)) * limits.same_lines,
        "word_length": (chars < words * limits.shortest_word) | (chars > words * limits.longest_word),
        "capitals": capitals * 100 > chars * limits.capitals,
    }


def estimate(docs: DataFrame, limits: Limits, text: str = "text", known: bool = False) -> dict[str, tuple[float, float]]:
    """Each rule's cost in seconds a row and the share it rejects, on a small sample written to the shared folder.

    A job evaluates a rule ``TURNS`` times on every row of the sample, whose words are there already; what the same job
    takes without a rule is subtracted. Costs are rounded to powers of four, so that the order does not follow noise. With
    ``known`` the base features are there already too, as where ``measure`` evaluates its rules.
    """
    rows = staged(docs.select(F.col(text).alias("text")).sample(False, SAMPLE_SHARE, 1).limit(SAMPLE_ROWS))
    sample = materialise(rows.withColumns(features()) if known else rows, "quality-sample")
    turns = sample.coalesce(1).withColumn(f"{_W}turn", F.explode(F.sequence(F.lit(1), F.lit(TURNS))))

    def timed(condition: Column) -> tuple[float, int, int]:
        best = None
        for _ in range(JOBS):
            began = time.perf_counter()
            n, rejected = turns.agg(F.count(F.lit(1)), F.count_if(condition)).first()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        return best, n, rejected

    timed(F.size(f"{_W}words") < 0)  # the first job reads the sample and starts up
    base, n, _ = timed((F.size(f"{_W}words") < 0) | (F.length("text") < 0))
    found = {}
    for name, condition in rules(limits, known=known).items():
        took, n, rejected = timed(condition)
        found[name] = (cost(took - base, n), rejected / n if n else 0.0)
    discard(sample)
    return found


def cost(seconds: float, rows: int) -> float:
    """Seconds a row, as a power of four; no less than four microseconds, below which a job's own time blurs it."""
    return 4.0 ** round(math.log(max(seconds / max(rows, 1), 4.0**-9), 4))


def order(estimates: dict[str, tuple[float, float]]) -> list[str]:
    """Rules by rejection per cost, best first; ties by name."""
    return sorted(estimates, key=lambda r: (-estimates[r][1] / estimates[r][0], r))


def verdict(limits: Limits, ordered: list[str], text: str = "text", known: bool = False) -> Column:
    """The first rule, in this order, that rejects the document; null if none does."""
    conditions = rules(limits, text, known)
    out = F.when(conditions[ordered[0]], ordered[0])
    for name in ordered[1:]:
        out = out.when(conditions[name], name)
    return out


def screen(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The documents that pass every rule, with their own columns."""
    limits = limits or Limits()
    rows = columns.plain(docs, "text")
    ordered = order(estimate(rows, limits))
    return staged(rows).where(verdict(limits, ordered).isNull() & (F.col(f"{_W}row") >= 0)).select(rows.columns).toDF(*docs.columns)


def measure(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Each row's features and verdict: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed (too few words or repeated windows), kept, and rejected_by (null if kept)."""
    limits = limits or Limits()
    docs = columns.plain(docs, "doc_id", "text").select("doc_id", "text")
    ordered = order(estimate(docs, limits, known=True))
    rows = staged(docs)
    here = F.col(f"{_W}row") >= 0  # always; it keeps a caller's filters above the shared words
    rows = rows.select("doc_id", "text", *[F.when(here, x).alias(name) for name, x in features().items()])
    base = rules(limits, known=True)
    rows = rows.withColumn("base_failed", base["too_few_words"] | base["repeated_windows"]).withColumn("rejected_by", verdict(limits, ordered, known=True))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


#: The same for DuckDB. ``rejected_by`` depends on the order of the rules and is not part of it.
SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM g),
c AS (SELECT r, count(DISTINCT j) AS covered FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM h WHERE n > 1) GROUP BY r),
f AS (
  SELECT doc_id, text, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS capitals
  FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 100 * capitals > 40 * word_chars) AS kept
FROM b
"""
