"""Registered queries of the training-data operators: each applies one to its whole table and derives
the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chunk_fingerprints,
    embedding_dedup,
    fim,
    hard_negatives,
    langid,
    line_dedup,
    lm_scoring,
    packing,
    pieces,
    quality,
    search,
    simhash,
    suffix_dedup,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text (of the empty text for a null id), modulo ``modulus``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=100).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, max_bits=2).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"), trained_on=remainder(4) != 2).select(
        "doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score"
    )


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_fingerprints.compare_edited(_table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return lm_scoring.score(documents, trained_on=remainder(5) != 1, order=3, mu=(300.0, 5.0)).select(
        "doc_id", (remainder(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), capacity=1024, keep_ids=False)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeated_lines(_table(spark, sf_dir, "documents"), lines=3).select(
        "doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_table(spark, sf_dir, "documents"), is_query=F.col("doc_id") % 20 == 0, k=10)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.score(_table(spark, sf_dir, "documents"), labels, trained_on=remainder(4) != 2).select(
        "doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.decode(pieces.encode(_table(spark, sf_dir, "documents"))).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.transform(_table(spark, sf_dir, "documents"), seed=1, plain_from=90, spm_below=20).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(), 256).alias("restored_sha256"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(vectors, is_anchor=F.col("vec_id") % 100 == 0).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.98, recall=0.999).select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_simhash_near_dedup,
        op3_language_id,
        op4_document_fingerprints,
        op5_lm_scoring,
        op6_best_fit_packing,
        op7_line_dedup,
        op8_exact_topk_search,
        op9_quality_classifier,
        op10_sentencepiece,
        op11_fill_in_middle,
        op12_hard_negatives,
        op13_embedding_near_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op7_line_dedup": line_dedup.ORACLE,
    "op11_fill_in_middle": fim.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_embedding_near_dedup": embedding_dedup.ORACLE,
}
