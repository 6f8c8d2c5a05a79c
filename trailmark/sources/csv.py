"""Users / events readers and CSV writers.

CSV columns are found by their header names, in any order, and read without an
inference pass: 64-bit ids, dates, timezone-free timestamps (``2024-01-05 10:00:00``,
with ``T``, without seconds or with fractions). Empty text is NULL; any other text that
is no value of its column's type is an error, and so is a record with too few or too many
fields. ``sources.quarantine`` keeps such records apart instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.schemas import EVENTS, USERS
from trailmark.sources.quarantine import read_checked, strict_rows

DATE_FORMAT = "yyyy-MM-dd"
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def read_users(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Users table: ``user_id, sign_up_date, plan_type, ab_test_group``."""
    return _read(spark, path, fmt, USERS)


def read_events(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Events table: ``event_id, user_id, event_timestamp, event_name``."""
    return _read(spark, path, fmt, EVENTS)


def _read(spark: SparkSession, path: str, fmt: str, schema) -> DataFrame:
    if fmt != "csv":
        return conform(spark.read.format(fmt).load(path), schema)
    return strict_rows(read_checked(spark, path, schema), schema)


def conform(df: DataFrame, schema) -> DataFrame:
    """Select and cast the schema's columns from a typed source (parquet, table)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def parse_temporal(users: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turn text dates / timestamps (as read without a schema) into typed columns."""
    users = users.withColumn("sign_up_date", F.to_date(F.col("sign_up_date").cast("string"), DATE_FORMAT))
    events = events.withColumn(
        "event_timestamp",
        F.to_timestamp_ntz(F.col("event_timestamp").cast("string"), F.lit(TIMESTAMP_FORMAT)),
    )
    return users, events


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a headered CSV directory (one part file per partition). A folder that exists is
    an error unless ``mode`` says otherwise.

    Dates and timestamps are written in the same text formats the readers
    expect, so a written table reads back unchanged.
    """
    (
        df.write.mode(mode)
        .option("header", True)
        .option("dateFormat", DATE_FORMAT)
        .option("timestampNTZFormat", TIMESTAMP_FORMAT)
        .csv(path)
    )


def export_filtered(df: DataFrame, path: str) -> None:
    """CSV export of a filtered users / events frame (the dashboard's download)."""
    write_csv(df, path)
