"""A training corpus from ``documents``: rejected languages go, repeated lines go, one document of each
near-duplicate group stays, repeated byte strings go, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns
of documents (the last one the packed pieces). Nulls, empty texts and repeated rows are treated as the
stages' operators say; a text that a stage empties stays as an empty document, and n_chars follows the
text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import langid, line_dedup, packing, simhash, suffix_dedup
from trailmark.llm.common import NULL_ID, stored
from trailmark.llm.queries import remainder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CARRIED = ("lang", "source")


def _with_text(kept: DataFrame) -> DataFrame:
    """The columns of documents, from a deduplicated text and what was carried along with it."""
    return kept.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, in no learned language, or of letters that no learned language explains go. Each row is
    judged by its own text: rows that share a doc_id, or have none, stay or go one by one."""
    found = langid.identify(docs, trained_on=remainder(4) != 2, carry=(*CARRIED, "n_chars"), with_text=True)
    return found.where(langid.in_language()).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(line_dedup.remove_repeated_lines(docs, lines=3, carry=CARRIED))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # grouped and joined by one key without nulls, so texts are shuffled once, after copies of a row are gone
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key")
    least = simhash.least_rows(docs, words=3, max_bits=2).select("hash", key)
    hashed = docs.select(*COLUMNS, F.xxhash64(F.col("text").cast("string")).alias("hash"), key)
    # of equal (doc_id, text) one row stays, the least by its other columns
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    one = hashed.groupBy("hash", "key").agg(F.min(F.struct(*others, "doc_id", "text")).alias("row"))
    return one.join(least, ["hash", "key"], "left_semi").select("row.*").select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(suffix_dedup.remove_repeats(docs, length=100, as_text=True, carry=CARRIED))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, capacity=1024, keep_ids=False)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenizers and language models are not SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None
