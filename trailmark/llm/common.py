"""Spark helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside the operators: sorts before every real id.
NULL_ID = -(2**63)

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id`` (null becomes NULL_ID) and ``text``; every other column is dropped here, so none can
    clash with an operator's own columns. Columns to carry along are packed into one, ``carry``."""
    workers_import(docs.sparkSession)
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        *([F.struct(*carry).alias("carry")] if carry else []),
    )


def public_id(column: str = "doc_id") -> Column:
    """The id as the caller knows it: NULL_ID back to null."""
    return F.when(F.col(column) != F.lit(NULL_ID), F.col(column))


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package when they see the driver's folders (local mode,
    a shared home). On other clusters the package is shipped with ``--py-files``."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which every executor sees. Only a local
    session without that setting (tests, a laptop) gets a scratch folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), f"trailmark-{os.getuid()}")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def shuffle_files_freed(spark: SparkSession):
    """Inside, a finished query's shuffle files are removed at once: its result is a table."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage ends here, so a lost
    executor never repeats what came before."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}-{name}"
    with shuffle_files_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_in_turn(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """The rows of all ``parts`` (one at least) as one table like ``stored``, a part at a time: shuffle files
    of a single part are on disk at once."""
    path = None
    for df in parts:
        spark = df.sparkSession
        path = path or f"{shared_folder(spark)}-{name}"
        with shuffle_files_freed(spark):
            df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
