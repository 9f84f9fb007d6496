"""One query for each operator of this package, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.llm import bpe, brown, clusters, contamination, jaccard, langid, merkle, packing, quality, substrings, tokens, topk, urls
from inkstream.session import ship, table


def prepare(spark: SparkSession) -> None:
    """Batches between the JVM and Python are bounded in bytes and hold fewer rows than by default, since texts are long;
    both settings stay with the session, as the results are worked out later. Executors get this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    ship(spark)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return table(spark, sf_dir, "documents")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.dedup(documents(spark, sf_dir).select("doc_id", "text"), 35, digest=True)
    return rows.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "class_id")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(documents(spark, sf_dir))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(topk.usable("embedding")).select("vec_id", topk.scaled("embedding", 256).alias("vector"))
    return topk.search(rows, F.col("vec_id") % 50 == 0, 5)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.RULES)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(documents(spark, sf_dir)).drop("rejected_by")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = contamination.decontaminate(docs, benchmark, 10, keep_text=False)
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"), 40, 5)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    return merkle.manifest(documents(spark, sf_dir), fields, tampered=tampered, changed=changed, proofs=False)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_token_counts, op3_substrings, op4_packing, op5_jaccard_join, op6_language_model, op7_top_k, op8_url_filters, op9_quality, op10_language, op11_decontamination, op12_clusters, op13_merkle)}
ORACLE_SQL: dict[str, str] = {"op3_substrings": substrings.SQL, "op7_top_k": topk.SQL, "op8_url_filters": urls.SQL, "op9_quality": quality.SQL, "op11_decontamination": contamination.SQL, "op12_clusters": clusters.SQL, "op13_merkle": merkle.SQL}
