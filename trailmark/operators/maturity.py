"""Retention over users observed long enough: right-censored risk sets.

A user who signed up on day s is at risk of being retained on day s + N only if the log reaches that
day. Each offset therefore has its own denominator, all sign-ups (active or not) with s + N up to the
log's last date, and a cohort too young for an offset gives NULL there instead of a low rate.

Plan shape: the events are scanned once and reduced to distinct (user, activity date) pairs. Each user is a
row per offset with the date that would count, and meets the pairs on (user, date), the key the pairs are
shuffled by already, so there is no second shuffle of activity and no per-user grouping: a row is an
observation. Rows that match no user are kept by the full join for one number only, the last date of the
log (all events count for it; those that are no activity are folded into one NULL key map-side). What follows
is a table with a row for each (cohort, sign-up date, offset), bounded by the calendar, on which the
last date is applied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.sqlexpr import lit_sql, pct_sql
from trailmark.operators.retention import Labeler, user_cohorts
from trailmark.schemas import ACTIVITY_EVENT, BASELINE_COHORT, COMPARISON_COHORT, RETENTION_DAYS


def observations(
    users: DataFrame,
    events: DataFrame,
    labeler: Labeler | None = None,
    days: Sequence[int] = RETENTION_DAYS,
    activity_event: str = ACTIVITY_EVENT,
) -> DataFrame:
    """Per (cohort, sign_up_date, day): sign-ups ``users``, those active on that day ``active``, and the log's
    last date ``observed_until`` (the same in each row, NULL for an empty log).

    Users without a sign-up date never signed up and are left out. Repeated rows of a user count each.
    """
    offsets = F.array(*[F.lit(int(d)) for d in dict.fromkeys(days)])
    targets = user_cohorts(users, labeler).where(F.col("sign_up_date").isNotNull()).select(
        F.col("user_id").alias("target_user"),
        "cohort",
        F.col("sign_up_date").cast("date").alias("sign_up_date"),
        F.explode(offsets).alias("day"),
    )
    targets = targets.withColumn("target_date", F.expr("date_add(sign_up_date, day)"))
    act = (F.col("event_name") == F.lit(activity_event)) & F.col("user_id").isNotNull()
    date = F.to_date("event_timestamp")
    seen = (
        events.select(F.when(act, F.col("user_id")).alias("user_id"), F.when(act, date).alias("date"), date.alias("any_date"))
        .groupBy("user_id", "date")
        .agg(F.max("any_date").alias("last_date"))
    )
    met = targets.join(
        seen, (F.col("target_user") == F.col("user_id")) & (F.col("target_date") == F.col("date")), "full"
    )
    counted = met.groupBy("cohort", "sign_up_date", "day").agg(
        F.count("day").alias("users"),
        F.count(F.when(F.col("day").isNotNull(), F.col("date"))).alias("active"),
        F.max("last_date").alias("last_date"),
    )
    # one row: as many entries as the calendar has (cohort, sign-up date, offset)
    whole = counted.agg(
        F.max("last_date").alias("observed_until"),
        F.collect_list(F.struct("cohort", "sign_up_date", "day", "users", "active")).alias("rows"),
    )
    return whole.selectExpr("observed_until", "inline(rows)").where(F.col("day").isNotNull())


def mature_retention(
    users: DataFrame,
    events: DataFrame,
    labeler: Labeler | None = None,
    days: Sequence[int] = RETENTION_DAYS,
    activity_event: str = ACTIVITY_EVENT,
) -> DataFrame:
    """Per cohort and day offset: sign-ups, those observed that long (``at_risk``), those of them active on
    exactly that day (``retained``), and the rate (%, 1 decimal), NULL while nobody is at risk."""
    rows = observations(users, events, labeler, days, activity_event)
    matured = "date_add(sign_up_date, day) <= observed_until"
    totals = rows.groupBy("cohort", "day").agg(
        F.sum("users").alias("cohort_size"),
        F.expr(f"coalesce(sum(CASE WHEN {matured} THEN users END), 0L) AS at_risk"),
        F.expr(f"coalesce(sum(CASE WHEN {matured} THEN active END), 0L) AS retained"),
    )
    return totals.selectExpr("*", f"{pct_sql('retained', 'at_risk', 1)} AS retention").orderBy(
        F.col("cohort").asc_nulls_last(), "day"
    )


def mature_retention_comparison(
    users: DataFrame,
    events: DataFrame,
    labeler: Labeler | None = None,
    baseline: str = BASELINE_COHORT,
    comparison: str = COMPARISON_COHORT,
    days: Sequence[int] = RETENTION_DAYS,
    activity_event: str = ACTIVITY_EVENT,
) -> DataFrame:
    """X5 side by side: per day, both cohorts' at-risk users and rates, the improvement in points and the
    relative change (half-to-even, 1 decimal); NULL where either cohort is too young."""
    rates = mature_retention(users, events, labeler, days, activity_event)

    def of(cohort: str, column: str) -> str:
        return f"max(CASE WHEN cohort = {lit_sql(cohort)} THEN {column} END)"

    wide = rates.groupBy("day").agg(
        F.expr(f"coalesce({of(baseline, 'at_risk')}, 0L) AS before_at_risk"),
        F.expr(f"{of(baseline, 'retention')} AS before_rate"),
        F.expr(f"coalesce({of(comparison, 'at_risk')}, 0L) AS after_at_risk"),
        F.expr(f"{of(comparison, 'retention')} AS after_rate"),
    )
    return wide.selectExpr(
        "*",
        "after_rate - before_rate AS improvement",
        "bround(try_divide(after_rate - before_rate, before_rate) * 100.0D, 1) AS relative_change",
    ).orderBy("day")
