"""Users / events derived from the shared test tables.

Mapping A turns the generic ``events`` table (event_type, value) into the
product event log and derives one user row per event user; mapping B treats
customers' orders as sign-ups and their shipped line items as activity.
Both are plain projections, aggregates and joins over the given tables, so
their work grows with the tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark import schemas as S
from trailmark.operators.retention import date_split_cohorts


# The columns used of the given tables: with them known, no footers are read to plan a query.
TABLES = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double",
    "customer": "c_custkey long, c_acctbal double",
    "orders": "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey long, l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- fixed values of mapping A ----------------------------------------------
# event_type / value thresholds -> product event name; first match wins.
PAID_BALANCE = 9000.0
COHORT_SPLIT = dt.date(2024, 1, 3)
BEFORE_LABEL = "before"
AFTER_LABEL = "after"
# -----------------------------------------------------------------------------


def mapped_event_name(event_type: Column, value: Column) -> Column:
    return (
        F.when(event_type == "signup", F.lit(S.SIGNED_UP))
        .when((event_type == "view") & (value >= 100), F.lit(S.CREATED_PROJECT))
        .when(event_type == "view", F.lit(S.USED_FEATURE))
        .when((event_type == "click") & (value >= 150), F.lit(S.INVITED_TEAMMATE))
        .when((event_type == "click") & (value >= 100), F.lit(S.VIEWED_PRICING))
        .when((event_type == "purchase") & (value >= 150), F.lit(S.UPGRADED_PLAN))
        .otherwise(event_type)
    )


def app_events(raw_events: DataFrame) -> DataFrame:
    """Mapping A event log: ``event_id, user_id, event_timestamp, event_name``.

    Every row is kept; one that maps to no product event keeps its raw type as name.
    """
    return raw_events.select(
        "event_id",
        "user_id",
        F.col("ts").alias("event_timestamp"),
        mapped_event_name(F.col("event_type"), F.col("value")).alias("event_name"),
    )


def app_users(raw_events: DataFrame, customer: DataFrame) -> DataFrame:
    """Mapping A users: one row per event user.

    ``sign_up_date`` is the date of the first ``signup`` event, ``plan_type`` is
    Paid for account balances of at least 9000, ``ab_test_group`` splits ids by
    parity. The customer join is left to the planner: a size-checked broadcast
    when the customer table is small, a shuffle join otherwise.
    """
    first_signup = raw_events.groupBy("user_id").agg(
        F.to_date(F.min(F.when(F.col("event_type") == "signup", F.col("ts")))).alias("sign_up_date")
    )
    balances = customer.select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    return first_signup.join(balances, "user_id", "left").select(
        "user_id",
        "sign_up_date",
        F.when(F.col("c_acctbal") >= PAID_BALANCE, F.lit("Paid")).otherwise(F.lit("Free")).alias("plan_type"),
        F.when(F.col("user_id") % 2 == 0, F.lit(S.AB_CONTROL)).otherwise(F.lit(S.AB_TREATMENT)).alias("ab_test_group"),
    )


def split_cohorts(split: dt.date = COHORT_SPLIT, before: str = BEFORE_LABEL, after: str = AFTER_LABEL):
    """Cohort labeler for mapping A: sign-ups before ``split`` vs. on/after it."""
    return date_split_cohorts(split, before, after)


def order_users(orders: DataFrame) -> DataFrame:
    """Mapping B users: each ordering customer, signed up on the date of the first order."""
    return orders.groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.to_date(F.min("o_orderdate")).alias("sign_up_date")
    )


def order_activity(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Mapping B activity: every shipped line item of a customer's orders.

    A shuffle join on the order key (both sides grow with the data); Catalyst
    prunes both scans to the two columns each side needs.
    """
    lines = lineitem.select("l_orderkey", "l_shipdate")
    owners = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey"))
    return lines.join(owners, "l_orderkey").select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_shipdate").alias("event_timestamp"),
        F.lit(S.USED_FEATURE).alias("event_name"),
    )


def order_journeys(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Mapping B as one journey table: every order date (a sign-up candidate) of a customer with the shipping
    date of each of its lines, or NULL for an order without lines. Each table is read once."""
    lines = lineitem.select("l_orderkey", F.col("l_shipdate").alias("event_timestamp"))
    placed = orders.select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("sign_up_date"))
    joined = placed.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("user_id", "sign_up_date", "event_timestamp")


def load_journeys_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_journeys(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


def load_mapping_a(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(users, events) of mapping A from ``events`` and ``customer``."""
    raw = table(spark, sf_dir, "events")
    return app_users(raw, table(spark, sf_dir, "customer")), app_events(raw)


def load_mapping_b(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(users, activity events) of mapping B from ``orders`` and ``lineitem``."""
    orders = table(spark, sf_dir, "orders")
    return order_users(orders), order_activity(orders, table(spark, sf_dir, "lineitem"))


# --- fixed values: how the text versions of the event log are damaged and dated -----
EVENT_FIELDS = ("event_id", "user_id", "event_timestamp", "event_name")
KEYED_BUCKETS = 8
KEYED_SINCE, KEYED_UNTIL = dt.date(2024, 1, 8), dt.date(2024, 1, 15)
# -------------------------------------------------------------------------------------


def damaged_lines(events: DataFrame) -> DataFrame:
    """The event log as CSV lines, every row once; of every fifty ids six have a fault: short, long, a user id
    that is no number, a time that is none, a blank line, and two faults at once."""
    fields = {
        "id": "coalesce(CAST(event_id AS STRING), '')",
        "user": "coalesce(CAST(user_id AS STRING), '')",
        "at": "coalesce(date_format(event_timestamp, 'yyyy-MM-dd HH:mm:ss'), '')",
        "name": "coalesce(event_name, '')",
    }
    lines = {
        0: "{id}, {user}",
        1: "{id}, {user}, {at}, {name}, 'more'",
        2: "{id}, concat('u', {user}), {at}, {name}",
        3: "{id}, {user}, 'soon', {name}",
        4: "''",
        5: "'x', {user}, 'soon', {name}",
    }
    cases = " ".join(f"WHEN {k} THEN concat_ws(',', {v.format(**fields)})" for k, v in lines.items())
    return events.selectExpr(f"CASE event_id % 50 {cases} ELSE concat_ws(',', {', '.join(fields.values())}) END AS line")


def mixed_times(events: DataFrame) -> DataFrame:
    """``event_id`` and ``event_timestamp`` as text, in ten forms by the last digit of the id (two of them no time)."""
    forms = [
        "date_format(event_timestamp, 'yyyy-MM-dd')",
        "date_format(event_timestamp, 'yyyy-MM-dd HH:mm:ss')",
        "date_format(event_timestamp, \"yyyy-MM-dd'T'HH:mm\")",
        "date_format(event_timestamp, 'yyyy-MM-dd HH:mm:ss.SSSSSS')",
        "date_format(event_timestamp, \"yyyy-MM-dd'T'HH:mm:ss'+02:00'\")",
        "date_format(event_timestamp, 'd/M/yyyy HH:mm')",
        "date_format(event_timestamp, 'M/d/yyyy HH:mm:ss')",
        "'soon'",
        "NULL",
        "date_format(event_timestamp, \"yyyy-MM-dd HH:mm:ss'Z'\")",
    ]
    cases = " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(forms))
    return events.selectExpr("event_id", f"CASE event_id % 10 {cases} END AS event_timestamp")
