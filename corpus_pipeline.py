"""The corpus pipeline: five stages over ``documents``, each one an operator of ``inkstream.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written to the shared folder and read again as
the next one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.llm import columns, jaccard, langid, packing, quality, substrings
from inkstream.llm.queries import prepare
from inkstream.session import materialise, release, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    prepare(spark)
    return quality.screen(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    prepare(spark)
    return langid.screen(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that link by their 5-word shingles, the one with the least doc_id.

    Texts count, not ids: rows that repeat one doc_id with texts that do not link all stay, and of rows with one doc_id and
    one set of shingles (or one text, if it has no words) one stays. Rows without a doc_id take part under a number made
    from their text.
    """
    prepare(spark)
    made = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 62))
    plain = columns.plain(docs, "doc_id", "text")
    rows = plain.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), made))
    every, classes = jaccard.groups(rows.select(F.col("id").alias("doc_id"), "text"))
    first = classes.groupBy("group").agg(F.min(F.struct(F.col("class_id").alias("kept"), "one", "two")).alias("x")).select("x.*")
    blank = every.where("n = 0").select(F.col("doc_id").alias("kept"), "one", "two").distinct()
    counts = every.groupBy(F.col("doc_id").alias("kept")).agg(F.count(F.lit(1)).alias("rows"))
    kept = materialise(first.union(blank).join(counts, "kept"), "kept")
    once = rows.join(kept.where("rows = 1"), F.col("id") == F.col("kept")).select(plain.columns)
    again = rows.join(kept.where("rows > 1").select("kept").distinct(), F.col("id") == F.col("kept"), "left_semi")
    again = again.withColumn("set", F.arrow_udf(jaccard.hashed, "struct<one: bigint, two: bigint>")("text"))
    again = again.join(kept.where("rows > 1"), (F.col("id") == F.col("kept")) & (F.col("set.one") == F.col("one")) & (F.col("set.two") == F.col("two")))
    sortable = [f.name for f in plain.schema if f.dataType.typeName() not in ("array", "map", "struct", "variant")]
    blank_text = F.when((F.col("one") == 0) & (F.col("two") == 0), F.col("text"))  # a set without shingles
    first = F.min_by(F.struct(*plain.columns), F.struct("text", *sortable)).alias("row")  # tasks keep one of equal rows before the shuffle
    return once.union(again.groupBy("id", "one", "two", blank_text.alias("blank")).agg(first).select("row.*")).toDF(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 35 words or more that occur elsewhere too.

    A text without such a passage stays as it is; of the others, the words that are left are joined by one space.
    """
    prepare(spark)
    plain = columns.plain(docs, "doc_id", "text", *[c for c in docs.columns if c == "n_chars"])
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in plain.columns:
        new["n_chars"] = F.when(changed, F.length("kept").cast(plain.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return substrings.dedup(plain, 35).select(*[new[c].alias(c) if c in new else c for c in plain.columns]).toDF(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences of at most 2048 tokens."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]

#: Language identification and tokens are beyond SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``. Tables of a stage are deleted once its result is written."""
    docs, others = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
        release(spark, keep=[*others, written()[-1]])
    return STAGES[-1][1](spark, docs, sf_dir)
