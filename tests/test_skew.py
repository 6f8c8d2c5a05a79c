"""A user holding a third of all events: plans stay split / pre-aggregated, results exact."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from tools.oracle_check import digest
from trailmark.operators import funnel, retention
from trailmark.plans.oracle import ORACLE_SQL, over_tables
from trailmark.sources.fixtures import split_cohorts

N_EVENTS, N_USERS = 90_000, 3_000

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def skewed(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    users = spark.range(N_USERS).select(
        F.col("id").alias("user_id"),
        F.expr("date'2024-01-01' + CAST(id % 5 AS INT)").alias("sign_up_date"),
        F.lit("Free").alias("plan_type"),
        F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("ab_test_group"),
    )
    # every third event belongs to user 0
    events = spark.range(N_EVENTS).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % N_USERS).cast("long").alias("user_id"),
        F.expr("timestamp_ntz'2024-01-01 08:00:00' + make_dt_interval(CAST(id % 40 AS INT))").alias("event_timestamp"),
        F.when(F.col("id") % 7 == 0, "signed_up").otherwise("used_feature_X").alias("event_name"),
    )
    yield users, events
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _final_plan(df) -> str:
    """Run the DataFrame's own plan in the JVM (no rows to Python) and return AQE's final plan."""
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    return qe.executedPlan().toString()


def _reference(users, events, name):
    con = duckdb.connect()
    con.register("users", users.toArrow())
    con.register("events", events.toArrow())
    res = con.execute(over_tables(ORACLE_SQL[name]))
    return [c[0] for c in res.description], res.fetchall()


def test_event_level_join_is_split(spark, skewed):
    users, events = skewed
    df = retention.user_activity(users, events, labeler=split_cohorts())
    plan = _final_plan(df)
    assert "isFinalPlan=true" in plan
    assert "SortMergeJoin(skew=true)" in plan
    hot = events.where("user_id = 0 AND event_name = 'used_feature_X'").count()
    assert df.where("user_id = 0").count() == hot


def test_retention_pre_aggregates_hot_user(spark, skewed):
    users, events = skewed
    df = retention.cohort_retention(users, events, labeler=split_cohorts())
    plan = _final_plan(df)
    # the first exchange on the activity side carries partial (user, day) aggregates
    assert "partial_count" in plan
    cols, ref = _reference(users, events, "cohort_retention")
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(cols, ref)[0]


def test_funnel_exact_under_skew(spark, skewed):
    users, events = skewed
    df = funnel.funnel_steps(events)
    cols, ref = _reference(users, events, "funnel_steps")
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(cols, ref)[0]


def test_salted_event_join_is_exact_and_spread(spark, skewed):
    users, events = skewed
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plain = retention.user_activity(users, events, labeler=split_cohorts())
        salted = retention.user_activity(users, events, labeler=split_cohorts(), salt=8)
        assert salted.columns == plain.columns
        assert sorted(map(tuple, salted.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
        # the hot user's events land on several join keys
        keys = salted.select(F.expr("pmod(xxhash64(user_id, event_timestamp, event_name), 8)").alias("k")).where(
            "user_id = 0"
        )
        assert keys.distinct().count() == 8
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
