"""Cohort retention: sign-up cohorts, day-N activity flags, retention rates and reshapes.

Retention base (as in the analysis this mirrors): users of a cohort with at least
one activity event, at any offset. A user counts as retained on day N when an
activity event falls on calendar day ``sign_up_date + N``.

Plan shape for the rates: activity events are first reduced to distinct (user, activity
date) pairs with an event count, combined map-side, so a user with a third of all events
becomes a few hundred rows at most; only that reduced set is joined to users, and whether a
side of that join is broadcast is left to the planner. The per-cohort aggregate is tiny.

Where sign-ups and activity come from one table already joined (a *journey* table: one row
per sign-up candidate and activity event of a user), the ``journey_*`` forms need no join of
users: one aggregate per user takes the first sign-up and the set of active dates.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.frames import sort_few
from trailmark.functions.sqlexpr import bitmask_agg, lit_sql, pct_sql, stack_rows, unpack_bits
from trailmark.schemas import (
    ACTIVITY_EVENT,
    BASELINE_COHORT,
    COMPARISON_COHORT,
    MONTH_COHORTS,
    RETENTION_DAYS,
)

Labeler = Callable[[Column], Column]


def month_cohorts(months: Sequence[tuple[int, str]] = MONTH_COHORTS) -> Labeler:
    """Label by sign-up month only (the year is ignored); other months are NULL."""

    def label(sign_up_date: Column) -> Column:
        m = F.month(sign_up_date)
        expr = None
        for month, text in months:
            expr = F.when(m == month, F.lit(text)) if expr is None else expr.when(m == month, F.lit(text))
        return expr

    return label


def date_split_cohorts(split: dt.date, before: str = "before", after: str = "after") -> Labeler:
    """Label sign-ups before ``split`` vs. on / after it (NULL dates stay NULL)."""

    def label(sign_up_date: Column) -> Column:
        return F.when(sign_up_date < F.lit(split), F.lit(before)).when(sign_up_date >= F.lit(split), F.lit(after))

    return label


def user_cohorts(users: DataFrame, labeler: Labeler | None = None) -> DataFrame:
    """``user_id, sign_up_date, cohort``."""
    labeler = labeler or month_cohorts()
    return users.select(
        "user_id",
        "sign_up_date",
        labeler(F.col("sign_up_date").cast("date")).alias("cohort"),
    )


def user_activity(
    users: DataFrame,
    events: DataFrame,
    labeler: Labeler | None = None,
    activity_event: str = ACTIVITY_EVENT,
    salt: int | None = None,
) -> DataFrame:
    """Each activity event of a cohort user with its whole-day offset from sign-up.

    ``days_since_signup`` compares calendar dates. Event-level output: the join
    runs on ``user_id``; with AQE a hot user's partition is split by skew-join
    handling. ``salt=N`` spreads every user's events over N join keys instead
    (users rows are replicated N times), for sessions without AQE. The salt is a
    hash of the row, not a random number, so a recomputed task after an executor
    loss assigns the same rows to the same keys.
    """
    cohorts = user_cohorts(users, labeler)
    acts = events.where((F.col("event_name") == F.lit(activity_event)) & F.col("user_id").isNotNull()).select(
        "user_id", "event_timestamp", "event_name", *([c for c in ("event_id",) if salt and c in events.columns])
    )
    if salt and salt > 1:
        row = [c for c in ("event_id", "user_id", "event_timestamp", "event_name") if c in acts.columns]
        acts = acts.withColumn("_salt", F.expr(f"pmod(xxhash64({', '.join(row)}), {int(salt)})"))
        cohorts = cohorts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(int(salt) - 1))))
        joined = cohorts.join(acts, ["user_id", "_salt"], "inner")
    else:
        joined = cohorts.join(acts, "user_id", "inner")
    return joined.select(
        "user_id",
        "cohort",
        "sign_up_date",
        "event_timestamp",
        "event_name",
        F.datediff(F.to_date("event_timestamp"), F.col("sign_up_date").cast("date")).alias("days_since_signup"),
    )


def activity_days(events: DataFrame, activity_event: str = ACTIVITY_EVENT) -> DataFrame:
    """Distinct (user, activity date) with the number of activity events on that date."""
    return (
        events.where((F.col("event_name") == F.lit(activity_event)) & F.col("user_id").isNotNull())
        .groupBy("user_id", F.to_date("event_timestamp").alias("activity_date"))
        .agg(F.count(F.lit(1)).alias("n_events"))
    )


def _active_offsets(
    users: DataFrame, events: DataFrame, labeler: Labeler | None, activity_event: str
) -> DataFrame:
    """(cohort, user_id, n_events, offset) rows of every cohort user's activity.

    Activity is reduced to (user, date) counts before the join, so a hot user is a
    few rows per day before any shuffle. Which side is broadcast, if any, is left to
    the planner and its runtime sizes.
    """
    cohorts = user_cohorts(users, labeler)
    acts = activity_days(events, activity_event)
    return cohorts.join(acts, "user_id", "inner").select(
        "cohort",
        "user_id",
        "n_events",
        F.datediff(F.col("activity_date"), F.col("sign_up_date").cast("date")).alias("offset"),
    )


def user_retention_flags(
    users: DataFrame,
    events: DataFrame,
    labeler: Labeler | None = None,
    days: Sequence[int] = RETENTION_DAYS,
    activity_event: str = ACTIVITY_EVENT,
) -> DataFrame:
    """Per (cohort, user): 0/1 active on exactly day N for each N in ``days``.

    Offsets are not filtered before grouping: any activity makes a user part of
    the cohort's base.
    """
    active = _active_offsets(users, events, labeler, activity_event)
    masks = active.groupBy("cohort", "user_id").agg(bitmask_agg("offset", list(days), "day_mask"))
    return masks.selectExpr("cohort", "user_id", *unpack_bits("day_mask", [f"day_{d}" for d in days]))


def cohort_retention(
    users: DataFrame,
    events: DataFrame,
    labeler: Labeler | None = None,
    days: Sequence[int] = RETENTION_DAYS,
    activity_event: str = ACTIVITY_EVENT,
) -> DataFrame:
    """Per cohort: active users and % retained on each day (1 decimal), by label.

    ``cohort_size`` counts rows of O16, which are unique per (cohort, user) with a
    non-NULL user, so it equals the distinct user count without a distinct aggregate.
    """
    flags = user_retention_flags(users, events, labeler, days, activity_event)
    return retention_from_flags(flags, days)


def retention_from_flags(flags: DataFrame, days: Sequence[int] = RETENTION_DAYS) -> DataFrame:
    """O17 from an O16-shaped table (one row per cohort and user)."""
    rates = [F.expr(pct_sql(f"sum(day_{d})", "count(1)", 1)).alias(f"day_{d}_retention") for d in days]
    per_cohort = flags.groupBy("cohort").agg(F.count(F.lit(1)).alias("cohort_size"), *rates)
    return sort_few(per_cohort, F.col("cohort").asc_nulls_last())


def retention_matrix(
    users: DataFrame,
    events: DataFrame,
    labeler: Labeler | None = None,
    days: Sequence[int] = RETENTION_DAYS,
) -> DataFrame:
    """Cohort x day matrix of retention rates (``cohort, day_1, day_7, ...``)."""
    r = cohort_retention(users, events, labeler, days)
    return r.selectExpr("cohort", *[f"day_{d}_retention AS day_{d}" for d in days])


def retention_curve(
    users: DataFrame,
    events: DataFrame,
    labeler: Labeler | None = None,
    days: Sequence[int] = RETENTION_DAYS,
) -> DataFrame:
    """Long form ``cohort, day, retention``: one curve per cohort."""
    r = cohort_retention(users, events, labeler, days)
    rows = [["cohort", lit_sql(d), f"day_{d}_retention"] for d in days]
    return stack_rows(r, rows, ["cohort", "day", "retention"])


def _two_cohorts(r: DataFrame, baseline: str, comparison: str, days: Sequence[int]) -> DataFrame:
    """Baseline and comparison cohorts' rates side by side in one row."""
    cols = []
    for d in days:
        col = f"day_{d}_retention"
        cols.append(f"max(CASE WHEN cohort = {lit_sql(baseline)} THEN {col} END) AS base_{d}")
        cols.append(f"max(CASE WHEN cohort = {lit_sql(comparison)} THEN {col} END) AS comp_{d}")
    return r.selectExpr(*cols)


def retention_improvement(
    users: DataFrame,
    events: DataFrame,
    labeler: Labeler | None = None,
    baseline: str = BASELINE_COHORT,
    comparison: str = COMPARISON_COHORT,
) -> DataFrame:
    """Comparison minus baseline cohort, in points, at day 7 and day 1."""
    return improvement_from_retention(cohort_retention(users, events, labeler), baseline, comparison)


def improvement_from_retention(
    r: DataFrame, baseline: str = BASELINE_COHORT, comparison: str = COMPARISON_COHORT
) -> DataFrame:
    """O20 from an O17-shaped result (one row per cohort)."""
    w = _two_cohorts(r, baseline, comparison, (1, 7))
    return w.selectExpr("comp_7 - base_7 AS day_7_improvement", "comp_1 - base_1 AS day_1_improvement")


def retention_comparison(
    users: DataFrame,
    events: DataFrame,
    labeler: Labeler | None = None,
    baseline: str = BASELINE_COHORT,
    comparison: str = COMPARISON_COHORT,
    days: Sequence[int] = RETENTION_DAYS,
) -> DataFrame:
    """One row per day: both cohorts' rates, improvement (points) and relative change.

    ``relative_change = improvement / before_rate * 100`` rounded half-to-even to
    1 decimal; NULL when the baseline rate is 0.
    """
    return comparison_from_retention(cohort_retention(users, events, labeler, days), baseline, comparison, days)


def comparison_from_retention(
    r: DataFrame,
    baseline: str = BASELINE_COHORT,
    comparison: str = COMPARISON_COHORT,
    days: Sequence[int] = RETENTION_DAYS,
) -> DataFrame:
    """O21 from an O17-shaped result (one row per cohort)."""
    w = _two_cohorts(r, baseline, comparison, days)
    rows = []
    for d in days:
        base, comp = f"base_{d}", f"comp_{d}"
        rows.append(
            [
                lit_sql(f"Day {d}"),
                lit_sql(d),
                base,
                comp,
                f"{comp} - {base}",
                f"bround(try_divide({comp} - {base}, {base}) * 100.0D, 1)",
            ]
        )
    names = ["period", "day", "before_rate", "after_rate", "improvement", "relative_change"]
    return stack_rows(w, rows, names)


def retention_ratio_doc(
    users: DataFrame,
    events: DataFrame,
    labeler: Labeler | None = None,
    day: int = 7,
    activity_event: str = ACTIVITY_EVENT,
) -> DataFrame:
    """D3: per cohort, day-``day`` activity *events* over distinct active users (a fraction).

    Computed from the per-(user, date) event counts, so the event-level rows are
    never materialised.
    """
    active = _active_offsets(users, events, labeler, activity_event)
    return active.groupBy("cohort").agg(
        (
            F.sum(F.when(F.col("offset") == F.lit(day), F.col("n_events")))
            / F.count_distinct("user_id")
        ).alias(f"day_{day}_retention")
    )


def journey_flags(
    journeys: DataFrame, labeler: Labeler | None = None, days: Sequence[int] = RETENTION_DAYS
) -> DataFrame:
    """O16 from a journey table: ``user_id``, ``sign_up_date`` (its least counts) and ``event_timestamp`` of an
    activity event, or NULL in rows that only tell of a sign-up.

    One shuffle, by user: dates are combined map-side into sets, which the calendar bounds.
    """
    labeler = labeler or month_cohorts()
    known = journeys.where(F.col("user_id").isNotNull())
    per_user = known.groupBy("user_id").agg(
        F.min(F.to_date("sign_up_date")).alias("sign_up_date"),
        F.collect_set(F.to_date("event_timestamp")).alias("active_dates"),
    )
    active = per_user.where(F.size("active_dates") > 0).withColumn("cohort", labeler(F.col("sign_up_date")))
    flags = [f"CAST(coalesce(array_contains(active_dates, date_add(sign_up_date, {d})), false) AS INT) AS day_{d}" for d in days]
    return active.selectExpr("cohort", "user_id", *flags)


def journey_ratio_doc(journeys: DataFrame, labeler: Labeler | None = None, day: int = 7) -> DataFrame:
    """D3 from a journey table: events are counted per (user, date) first, so a hot user is a row per day."""
    labeler = labeler or month_cohorts()
    known = journeys.where(F.col("user_id").isNotNull())
    per_day = known.groupBy("user_id", F.to_date("event_timestamp").alias("date")).agg(
        F.min(F.to_date("sign_up_date")).alias("sign_up_date"), F.count("event_timestamp").alias("n_events")
    )
    per_user = per_day.groupBy("user_id").agg(
        F.min("sign_up_date").alias("sign_up_date"),
        F.collect_list(F.when(F.col("date").isNotNull(), F.struct("date", "n_events"))).alias("active"),
    )
    of_day = f"filter(active, x -> x.date = date_add(sign_up_date, {int(day)}))"
    active = per_user.where(F.size("active") > 0).select(
        labeler(F.col("sign_up_date")).alias("cohort"), F.expr(f"get({of_day}, 0).n_events AS n_events")
    )
    return active.groupBy("cohort").agg((F.sum("n_events") / F.count(F.lit(1))).alias(f"day_{day}_retention"))
