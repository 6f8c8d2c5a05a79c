"""The event log as a table keyed for reading: partitioned by event date, bucketed by user.

A filter on the date reads only those partitions, and whatever groups or joins by ``user_id`` reads the
buckets as they are, without a shuffle. Each (date, bucket) is written by one task, unless it is so large
that the runtime plan splits it, so a table has about days x buckets files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.session import ensure_checkpoint_dir

DATE, USER = "event_date", "user_id"


def save_keyed_events(events: DataFrame, table: str, buckets: int, path: str | None = None, mode: str = "errorifexists") -> None:
    """Save as a catalog table (under ``path`` if given). Events without a time are in the NULL partition,
    those without a user in bucket 42 mod ``buckets``. ``buckets``: user data of all dates in one should fit a task;
    tables that are joined by user need the same number."""
    dated = events.withColumn(DATE, F.to_date("event_timestamp"))
    placed = dated.withColumn("_bucket", F.expr(f"pmod(hash({USER}), {int(buckets)})"))
    together = placed.hint("rebalance", DATE, "_bucket").drop("_bucket")
    writer = together.write.mode(mode).format("parquet").partitionBy(DATE).bucketBy(buckets, USER).sortBy(USER)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def keyed_events(spark: SparkSession, table: str, since=None, until=None) -> DataFrame:
    """The saved events, from ``since`` to before ``until`` (dates; only these partitions are read)."""
    df = spark.table(table)
    if since is not None:
        df = df.where(F.col(DATE) >= F.lit(since))
    if until is not None:
        df = df.where(F.col(DATE) < F.lit(until))
    return df


def keyed_copy(events: DataFrame, buckets: int) -> DataFrame:
    """A keyed copy in the checkpoint folder, for repeated use within an application. Its table has a name of
    its own and stays in the catalog, which knows the buckets and partitions, until ``DROP TABLE``; like those
    of a checkpoint, the files stay."""
    spark = events.sparkSession
    table = f"keyed_{uuid.uuid4().hex}"
    save_keyed_events(events, table, buckets, path=f"{ensure_checkpoint_dir(spark)}/{table}")
    return spark.table(table)
