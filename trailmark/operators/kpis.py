"""Headline KPIs, daily series, event distribution and the explore filters.

Single-row KPIs over both tables are computed as one aggregate over a UNION of
narrow projections of users and events (each side partially aggregated per
partition), never as a join of the two tables.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.sqlexpr import bitmask_agg, lit_sql, ratio_sql
from trailmark.schemas import (
    AB_CONTROL,
    AB_TREATMENT,
    CREATED_PROJECT,
    INVITED_TEAMMATE,
    UPGRADED_PLAN,
)


def _total(col: str) -> str:
    """Sum of a 0/1 column that is 0 (not NULL) over empty input, like a row count."""
    return f"coalesce(CAST(sum({col}) AS BIGINT), 0L) AS {col}"


def _union_totals(*parts: DataFrame) -> DataFrame:
    """One aggregate over the union of same-shaped narrow projections."""
    combined = parts[0]
    for p in parts[1:]:
        combined = combined.unionByName(p)
    return combined


def kpi_totals(users: DataFrame, events: DataFrame, conversion_event: str = UPGRADED_PLAN) -> DataFrame:
    """Total users, total events, conversion events, and conversion events per user in %.

    The conversion rate counts *events*, not distinct users (a user who upgraded
    twice counts twice), as the overview does.
    """
    u = users.selectExpr("1 AS total_users", "0 AS total_events", "0 AS conversion_events")
    e = events.selectExpr(
        "0 AS total_users",
        "1 AS total_events",
        f"CASE WHEN event_name = {lit_sql(conversion_event)} THEN 1 ELSE 0 END AS conversion_events",
    )
    t = _union_totals(u, e).selectExpr(*[_total(c) for c in ("total_users", "total_events", "conversion_events")])
    return t.selectExpr("*", f"{ratio_sql('conversion_events', 'total_users')} AS conversion_rate")


def kpi_overview(
    users: DataFrame,
    events: DataFrame,
    activation_event: str = CREATED_PROJECT,
    invite_event: str = INVITED_TEAMMATE,
    conversion_event: str = UPGRADED_PLAN,
) -> DataFrame:
    """Activated / invited users (any such event) and conversion events, each as % of all users.

    Users are the event log's non-NULL ids; per-user flags and conversion counts
    come from one pass over the events (combined map-side), then everything
    lands in one aggregate together with the users count.
    """
    cols = ("total_users", "activated_users", "invited_users", "converted_events")
    # one pass over the events: per-user flags and conversion counts; the NULL-id
    # group contributes its conversion events but is not a user. Rows that can set
    # no flag are folded into that group, so they cost one shuffle row per task.
    keyed = events.select(
        F.when(F.col("event_name").isin(activation_event, invite_event), F.col("user_id")).alias("user_id"),
        "event_name",
    )
    per_user = (
        keyed.groupBy("user_id")
        .agg(
            bitmask_agg("event_name", [activation_event, invite_event], "m"),
            F.expr(f"count_if(event_name = {lit_sql(conversion_event)})").alias("c"),
        )
        .selectExpr(
            "0 AS total_users",
            "CASE WHEN user_id IS NULL THEN 0 ELSE m & 1 END AS activated_users",
            "CASE WHEN user_id IS NULL THEN 0 ELSE shiftright(m, 1) & 1 END AS invited_users",
            "c AS converted_events",
        )
    )
    total = users.selectExpr("1 AS total_users", "0 AS activated_users", "0 AS invited_users", "0 AS converted_events")
    t = _union_totals(total, per_user).selectExpr(*[_total(c) for c in cols])
    return t.selectExpr(
        "total_users",
        "activated_users",
        f"{ratio_sql('activated_users', 'total_users')} AS activated_pct",
        "invited_users",
        f"{ratio_sql('invited_users', 'total_users')} AS invited_pct",
        "converted_events",
        f"{ratio_sql('converted_events', 'total_users')} AS converted_pct",
    )


def daily_signups(users: DataFrame) -> DataFrame:
    """Sign-ups per calendar date (dates without sign-ups are absent)."""
    return (
        users.where(F.col("sign_up_date").isNotNull())
        .groupBy(F.to_date("sign_up_date").alias("date"))
        .agg(F.count(F.lit(1)).alias("signups"))
        .orderBy("date")
    )


def event_distribution(events: DataFrame) -> DataFrame:
    """Events per type, most frequent first (ties by name)."""
    return (
        events.where(F.col("event_name").isNotNull())
        .groupBy(F.col("event_name").alias("event_type"))
        .agg(F.count(F.lit(1)).alias("event_count"))
        .orderBy(F.col("event_count").desc(), F.col("event_type").asc())
    )


def daily_events_by_type(events: DataFrame) -> DataFrame:
    """Events per (calendar date, type), long form."""
    return (
        events.where(F.col("event_timestamp").isNotNull() & F.col("event_name").isNotNull())
        .groupBy(F.to_date("event_timestamp").alias("date"), "event_name")
        .agg(F.count(F.lit(1)).alias("event_count"))
        .orderBy("date", "event_name")
    )


def users_filtered(
    users: DataFrame,
    plans: Sequence[str] = ("Free", "Paid"),
    groups: Sequence[str] = (AB_CONTROL, AB_TREATMENT),
    months: Sequence[int] = (1, 2),
) -> DataFrame:
    """Users whose plan, group and sign-up month (year ignored) are all in the lists.

    An empty list selects nothing. The predicates are plain IN-lists, so the plan
    and group ones reach the scan of a stored users table.
    """
    return users.where(
        F.col("plan_type").isin(list(plans))
        & F.col("ab_test_group").isin(list(groups))
        & F.month("sign_up_date").isin(list(months))
    )


def parse_user_id(text: str | None) -> int | None:
    """The optional user-id filter: an integer if the text parses as one, else ignored (with a warning)."""
    if not text:
        return None
    try:
        return int(text)
    except ValueError:
        warnings.warn(f"user id filter {text!r} is not an integer; ignored", stacklevel=3)
        return None


def events_filtered(
    events: DataFrame,
    event_types: Sequence[str] | None = None,
    user_id_text: str | None = None,
) -> DataFrame:
    """Events of the selected types, optionally of one user.

    ``event_types=None`` keeps every type (the dashboard's default selection);
    the user id arrives as text and is applied only when it parses as an integer.
    """
    out = events
    if event_types is not None:
        out = out.where(F.col("event_name").isin(list(event_types)))
    uid = parse_user_id(user_id_text)
    if uid is not None:
        in_range = -(2**63) <= uid < 2**63
        out = out.where(F.col("user_id") == F.lit(uid)) if in_range else out.where(F.lit(False))
    return out


def event_types(events: DataFrame) -> DataFrame:
    """Distinct event types (NULL included), in order of first appearance in the log."""
    first_seen = events.groupBy("event_name").agg(F.min("event_id").alias("first_event_id"))
    return first_seen.orderBy(F.col("first_event_id").asc_nulls_last(), "event_name").select("event_name")


def dataset_summary(users: DataFrame, events: DataFrame) -> DataFrame:
    """Users by plan and by group, total events, and the sign-up date range, in one row."""

    def is_(col: str, value: str) -> str:
        return f"CASE WHEN {col} = {lit_sql(value)} THEN 1 ELSE 0 END"

    u = users.selectExpr(
        "1 AS total_users",
        f"{is_('plan_type', 'Free')} AS free_users",
        f"{is_('plan_type', 'Paid')} AS paid_users",
        f"{is_('ab_test_group', AB_CONTROL)} AS group_a_users",
        f"{is_('ab_test_group', AB_TREATMENT)} AS group_b_users",
        "0 AS total_events",
        "CAST(sign_up_date AS DATE) AS d",
    )
    e = events.selectExpr(
        "0 AS total_users",
        "0 AS free_users",
        "0 AS paid_users",
        "0 AS group_a_users",
        "0 AS group_b_users",
        "1 AS total_events",
        "CAST(NULL AS DATE) AS d",
    )
    counts = ("total_users", "free_users", "paid_users", "group_a_users", "group_b_users", "total_events")
    return _union_totals(u, e).selectExpr(
        *[_total(c) for c in counts], "min(d) AS first_sign_up", "max(d) AS last_sign_up"
    )
