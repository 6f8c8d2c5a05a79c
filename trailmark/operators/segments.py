"""The activation funnel by user segment, with totals, from grouping sets.

Plan shape: one scan of the events to a step bitmask per user (one shuffle on ``user_id``, as in the plain
funnel), joined to the users' segments. Users with equal segments and steps are counted together first,
so the grouping sets expand a table of at most (segment values) x (step sets) rows and not the users.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.sqlexpr import lit_sql, pct_sql, stack_rows, unpack_bits
from trailmark.operators.funnel import Step, dropoff_sql, user_step_mask
from trailmark.operators.retention import Labeler, month_cohorts
from trailmark.schemas import FUNNEL_STEPS

SEGMENTS = ("plan_type", "ab_test_group", "cohort")


def single_sets(segments: Sequence[str]) -> list[list[str]]:
    """The total, and each segment by itself."""
    return [[], *([s] for s in segments)]


def cube_sets(segments: Sequence[str]) -> list[list[str]]:
    """Every combination of segments, from the total to all of them together."""
    sets: list[list[str]] = [[]]
    for s in segments:
        sets += [[*old, s] for old in sets]
    return sets


def funnel_by_segment(
    users: DataFrame,
    events: DataFrame,
    segments: Sequence[str] = SEGMENTS,
    sets: Sequence[Sequence[str]] | None = None,
    labeler: Labeler | None = None,
    steps: Sequence[Step] = FUNNEL_STEPS,
) -> DataFrame:
    """The funnel (O3) of every segment in ``sets`` (default: the total and each segment by itself).

    ``segment`` names the grouping (``total``, ``plan_type``, ``plan_type+cohort``, ...). A segment column is
    NULL both in groupings without it and for users whose value is NULL or who are in no users row; the
    bits of ``grouping_id`` (first segment highest, 1 = not grouped by) tell the two apart. The total equals
    the plain funnel: all users of the events count. ``user_id`` is unique in users.
    """
    segments = list(segments)
    sets = [list(s) for s in (single_sets(segments) if sets is None else sets)]
    known = users
    if "cohort" in segments:
        known = users.withColumn("cohort", (labeler or month_cohorts())(F.col("sign_up_date").cast("date")))
    flags = [c for _, _, c, _ in steps]
    masks = user_step_mask(events, steps).join(known.select("user_id", *segments), "user_id", "left")
    alike = masks.groupBy(*segments, "step_mask").agg(F.count(F.lit(1)).alias("n"))
    alike = alike.selectExpr(*segments, "n", *unpack_bits("step_mask", flags))
    grouped = alike.groupingSets(sets, *segments).agg(
        F.grouping_id().alias("grouping_id"),
        *[F.expr(f"CAST(sum(n * {c}) AS BIGINT) AS n_{c}") for c in flags],
    )
    rates = [f"100.0D AS r_{flags[0]}"] + [f"{pct_sql(f'n_{c}', f'n_{flags[0]}', 1)} AS r_{c}" for c in flags[1:]]
    bit = {s: 1 << (len(segments) - 1 - i) for i, s in enumerate(segments)}
    name = ", ".join(f"CASE WHEN grouping_id & {bit[s]} = 0 THEN {lit_sql(s)} END" for s in segments)
    wide = grouped.selectExpr("*", f"coalesce(nullif(concat_ws('+', {name}), ''), 'total') AS segment", *rates)
    head = ["segment", "grouping_id", *segments]
    rows = [
        [*head, lit_sql(s[1]), lit_sql(s[0]), f"n_{s[2]}", f"r_{s[2]}", dropoff_sql(steps, i)] for i, s in enumerate(steps)
    ]
    names = [*head, "funnel_step", "step_number", "user_count", "conversion_rate", "drop_off_rate"]
    order = [F.col("grouping_id").desc(), *[F.col(s).asc_nulls_last() for s in segments], F.col("step_number")]
    return stack_rows(wide, rows, names).orderBy(*order)
