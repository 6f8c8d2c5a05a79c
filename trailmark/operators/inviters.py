"""Conversion of users who invited a teammate against those who did not, in the order it happened.

Plan shape: one aggregate per user takes the time of the first invite and of the first upgrade as conditional
minima (combined map-side, so a heavy user is one row per task and there is no window over raw events);
everything after it is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.sqlexpr import lit_sql, pct_sql, stack_rows
from trailmark.functions.stats import normal_quantile_sql
from trailmark.schemas import ALPHA, INVITED_TEAMMATE, UPGRADED_PLAN


def first_times(
    events: DataFrame,
    invite_event: str = INVITED_TEAMMATE,
    conversion_event: str = UPGRADED_PLAN,
    base_event: str | None = None,
) -> DataFrame:
    """Per user: ``first_invite``, ``first_upgrade`` (NULL if never). Users are the log's non-NULL ids, with
    ``base_event`` only those who did it at any time."""

    def first(name: str) -> str:
        return f"min(CASE WHEN event_name = {lit_sql(name)} THEN event_timestamp END)"

    known = events.where(F.col("user_id").isNotNull())
    times = known.groupBy("user_id").agg(
        F.expr(f"{first(invite_event)} AS first_invite"),
        F.expr(f"{first(conversion_event)} AS first_upgrade"),
        *([F.expr(f"bool_or(event_name <=> {lit_sql(base_event)}) AS in_base")] if base_event else []),
    )
    return times.where("in_base").drop("in_base") if base_event else times


def _wide(times: DataFrame) -> DataFrame:
    """One row: users, conversions and earlier upgrades of both groups."""
    return times.selectExpr(
        "count_if(first_invite IS NOT NULL) AS i_users",
        "count_if(first_upgrade > first_invite) AS i_conversions",
        "count_if(first_upgrade <= first_invite) AS i_before",
        "count_if(first_invite IS NULL) AS o_users",
        "count_if(first_invite IS NULL AND first_upgrade IS NOT NULL) AS o_conversions",
    )


def conversion_by_invite(
    events: DataFrame,
    invite_event: str = INVITED_TEAMMATE,
    conversion_event: str = UPGRADED_PLAN,
    base_event: str | None = None,
) -> DataFrame:
    """Two rows, ``invited`` and ``not_invited``: users, conversions and the rate (%, 2 decimals).

    An inviter converts by a first upgrade after the first invite; one at the same time or earlier cannot
    follow from it, so such users are no conversions, but stay in the group and are given as
    ``upgraded_before``. Both rows are there even when a group is empty (its rate is NULL).
    """
    wide = _wide(first_times(events, invite_event, conversion_event, base_event))
    rows = [
        ["'invited'", "i_users", "i_conversions", "i_before", pct_sql("i_conversions", "i_users", 2)],
        ["'not_invited'", "o_users", "o_conversions", "0L", pct_sql("o_conversions", "o_users", 2)],
    ]
    return stack_rows(wide, rows, ["segment", "users", "conversions", "upgraded_before", "conversion_rate"])


def invite_risk_ratio(
    events: DataFrame,
    invite_event: str = INVITED_TEAMMATE,
    conversion_event: str = UPGRADED_PLAN,
    base_event: str | None = None,
    alpha: float = ALPHA,
) -> DataFrame:
    """How many times likelier inviters convert: ``risk_ratio`` with its two-sided (1 - alpha) interval on the
    log scale (standard error sqrt(1/a - 1/n1 + 1/c - 1/n0)), and the difference in points.

    NULL where it is undefined: the ratio without conversions among the others, the interval without
    conversions in either group, everything for an empty group.
    """
    wide = _wide(first_times(events, invite_event, conversion_event, base_event))
    t = wide.selectExpr(
        "*",
        "try_divide(CAST(i_conversions AS DOUBLE), i_users) AS p1",
        "try_divide(CAST(o_conversions AS DOUBLE), o_users) AS p0",
        f"{normal_quantile_sql(lit_sql(1 - float(alpha) / 2))} AS z",
    )
    t = t.selectExpr(
        "*",
        "try_divide(p1, p0) AS ratio",
        "CASE WHEN i_conversions > 0 AND o_conversions > 0 THEN"
        " sqrt(1.0D / i_conversions - 1.0D / i_users + 1.0D / o_conversions - 1.0D / o_users) END AS se",
    )
    return t.selectExpr(
        "i_users AS inviters",
        "o_users AS others",
        "round(100.0D * (p1 - p0), 4) AS difference_pp",
        "round(ratio, 4) AS risk_ratio",
        "round(ratio * exp(-z * se), 4) AS ratio_low",
        "round(ratio * exp(z * se), 4) AS ratio_high",
        "ratio * exp(-z * se) > 1 OR ratio * exp(z * se) < 1 AS significant",
    )
