"""Row counts of input tables, from their Parquet footers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def footer_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose Parquet reader answers counts from the footers. The
    settings stay in it: other sessions are as they were."""
    counting = spark.newSession()
    v1 = [s for s in counting.conf.get("spark.sql.sources.useV1SourceList").split(",") if s != "parquet"]
    counting.conf.set("spark.sql.sources.useV1SourceList", ",".join(v1))
    counting.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return counting


def input_row_counts(spark: SparkSession, tables: Mapping[str, str]) -> DataFrame:
    """``table_name, n_rows`` for each name and Parquet path. The count is pushed into the scan, which reads
    no row groups: its work grows with the number of files, not rows."""
    counting = footer_session(spark)
    if not tables:
        raise ValueError("no tables to count")
    # a zero for each name: without any file a pushed count is NULL
    together = counting.range(1).select(
        F.explode(F.array(*[F.lit(name) for name in tables])).alias("table_name"), F.lit(0).cast("long").alias("n")
    )
    for name, path in tables.items():
        counted = counting.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))
        together = together.unionByName(counted.select(F.lit(name).alias("table_name"), "n"))
    return together.groupBy("table_name").agg(F.sum("n").alias("n_rows"))
