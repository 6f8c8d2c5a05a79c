"""DataFrame-level helpers for small, bounded results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort_few(df: DataFrame, *cols) -> DataFrame:
    """Order a result with a handful of rows by construction (one per A/B group
    or cohort label) inside one partition.

    A global ``orderBy`` would add a range-partitioning sample job and a shuffle;
    here the input is the partial aggregates of at most a few groups per map
    task, so one task orders them cheaply. Not for results that grow with the
    data (daily series keep ``orderBy``).
    """
    return df.coalesce(1).sortWithinPartitions(*cols)


def side_by_side(*parts: DataFrame) -> DataFrame:
    """Combine single-row frames with distinct columns into one row, without a join."""
    combined = parts[0]
    for p in parts[1:]:
        combined = combined.unionByName(p, allowMissingColumns=True)
    return combined.agg(*[F.max(c).alias(c) for c in combined.columns])
