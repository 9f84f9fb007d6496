"""Staged answers of models, checked by shape (X04, X08) and put into texts (X09); answers are JSON of any shape, read as
variants."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that say nothing of how an idea is carried out, and the least length of a note that does.
VAGUE, SPECIFIC_FROM = ["funny", "humor", "interesting"], 20


def parsed(answer: str | Column) -> Column:
    """The JSON of an answer, bare or in a fence, as a variant; null if it is none."""
    x = F.trim(F.col(answer) if isinstance(answer, str) else answer)
    return F.try_parse_json(F.regexp_replace(F.regexp_replace(x, r"^```(?:json)?\n", ""), r"\n```$", ""))


def _kind(v: Column, path: str) -> Column:
    """The type at a path, like STRING or ARRAY<...>; null if there is nothing."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _string(v: Column, path: str) -> Column:
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def scene_verdict(answer: Column, v: Column) -> Column:
    """X08: "ok", or the first fault of an answer: none, no JSON, no prompt, no anchors, no technique."""
    shape = F.coalesce(_kind(v, "$.visualAnchors"), F.lit(""))
    techniques = F.try_variant_get(v, "$.boringnessBreaker.selected", "array<variant>")
    return (
        F.when(answer.isNull() | (answer == ""), "no_answer")
        .when(v.isNull(), "no_json")
        .when(F.coalesce(_string(v, "$.finalImagePrompt"), F.lit("")) == "", "no_prompt")
        .when(~shape.startswith("OBJECT") & ~shape.startswith("ARRAY"), "no_anchors")
        .when(F.coalesce(F.cardinality(techniques), F.lit(0)) < 1, "no_technique")
        .otherwise("ok")
    )


def scene_confidence(v: Column) -> Column:
    """The answer's number, 0.5 if it has none; 0.15 less, down to 0, if its note is missing, short or vague."""
    number = F.coalesce(_kind(v, "$.confidence"), F.lit("")).rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
    own = F.when(number, F.try_variant_get(v, "$.confidence", "double")).otherwise(F.lit(0.5))
    note = F.coalesce(_string(v, "$.boringnessBreaker.executionNote"), F.lit(""))
    weak = (F.trim(note) == "") | F.lower(note).rlike("|".join(map(re.escape, VAGUE))) | (F.length(note) < SPECIFIC_FROM)
    return F.when(weak, F.greatest(F.lit(0.0), own - 0.15)).otherwise(own)


def scenes(df: DataFrame, one: str, two: str, negative: list[str], least: float = 0.55) -> DataFrame:
    """Of a staged answer and the one to a second try, the scene that counts: adds origin, fault, confidence, prompt
    and negative.

    The second counts only if the first lacks a technique. A scene that is faulty or not sure enough gives way to the
    fallback: origin is then "fallback", ``fault`` says why, and the rest is null. ``negative`` stands in for a list that
    the answer lacks.
    """
    df = df.withColumns({"__v1": parsed(one), "__v2": parsed(two)})
    df = df.withColumns({"__f1": scene_verdict(F.col(one), F.col("__v1")), "__f2": scene_verdict(F.col(two), F.col("__v2"))})
    again = F.col("__f1") == "no_technique"
    df = df.withColumns({"__v": F.when(again, F.col("__v2")).otherwise(F.col("__v1")), "__f": F.when(again, F.col("__f2")).otherwise(F.col("__f1"))})
    df = df.withColumn("__c", F.when(F.col("__f") == "ok", scene_confidence(F.col("__v"))))
    fault = F.when(F.col("__f") != "ok", F.col("__f")).when(F.col("__c") < least, "low_confidence")
    good = fault.isNull()
    avoided = F.coalesce(F.try_variant_get("__v", "$.negativePrompt", "array<string>"), F.array(*map(F.lit, negative)))
    df = df.withColumns({"origin": F.when(~good, "fallback").when(again, "retry").otherwise("first"), "fault": fault, "confidence": F.when(good, F.col("__c")), "prompt": F.when(good, _string(F.col("__v"), "$.finalImagePrompt")), "negative": F.when(good, avoided)})
    return df.drop("__v", "__f", "__c", "__v1", "__v2", "__f1", "__f2")


def delta_queries(answer: str | Column, n: int = 3) -> tuple[Column, Column]:
    """The queries of an answer, which must be exactly n strings and none of them blank; and what is wrong, else null."""
    v = parsed(answer)
    listed = F.try_variant_get(v, "$.deltaQueries", "array<variant>")
    strings = F.transform(listed, lambda q: F.when(F.schema_of_variant(q) == "STRING", F.try_variant_get(q, "$", "string")))
    blank = F.exists(strings, lambda q: F.trim(F.coalesce(q, F.lit(""))) == "")
    fault = F.when(v.isNull(), "no_json").when(F.coalesce(F.cardinality(listed), F.lit(-1)) != n, "not_exactly_" + str(n)).when(blank, "blank")
    return F.when(fault.isNull(), strings), fault


def composed(template: str, **parts: Column) -> Column:
    """A text with columns in the places of ``{name}``; all names must be given. Null parts count as empty."""
    pieces = re.split(r"\{(\w+)\}", template)
    if missing := {p for p in pieces[1::2] if p not in parts}:
        raise ValueError(f"no part for {sorted(missing)}")
    return F.concat(*[F.coalesce(parts[p], F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(pieces)])
