"""Activation funnel: per-user step flags, step counts, conversion and drop-off.

Plan shape: one scan of the event log, one hash shuffle on ``user_id`` (the
per-user step bitmask, combined map-side so a heavy user costs one row per map
task), then a global aggregate of one row. The per-step rows are produced from
that single row with SQL ``stack`` instead of a UNION of five re-scans, and
drop-off is computed on it too, so there is no un-partitioned window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.sqlexpr import bitmask_agg, lit_sql, pct_sql, stack_rows, unpack_bits
from trailmark.schemas import FUNNEL_STEPS

Step = tuple[int, str, str, str]


def user_step_mask(events: DataFrame, steps: Sequence[Step] = FUNNEL_STEPS) -> DataFrame:
    """Per user, the steps ever reached as one bitmask (bit k-1 for step k)."""
    return events.groupBy("user_id").agg(bitmask_agg("event_name", [name for *_, name in steps], "step_mask"))


def user_funnel_flags(events: DataFrame, steps: Sequence[Step] = FUNNEL_STEPS) -> DataFrame:
    """O1: per user, 0/1 "ever did step k" (no ordering between steps).

    Every user with any event gets a row; a NULL ``user_id`` forms its own group,
    as in SQL GROUP BY. The steps travel through the per-user shuffle as one
    bitmask and are unpacked after it.
    """
    return user_step_mask(events, steps).selectExpr("user_id", *unpack_bits("step_mask", [c for _, _, c, _ in steps]))


def flags_for_totals(events: DataFrame, steps: Sequence[Step] = FUNNEL_STEPS) -> DataFrame:
    """O1-shaped flags that give the same step *sums* as ``user_funnel_flags``, cheaper.

    Rows whose event is no step cannot set a flag, so their user id is replaced by
    NULL before the per-user aggregate: they collapse into the NULL-key group (one
    row per map task) instead of a row per user in the shuffle. That group adds
    nothing to any sum (unless real NULL-id rows carry steps, which the SQL
    grouping counts as well), and it keeps a log without any step events summing
    to 0 rather than NULL. Not for per-user output or user counts.
    """
    names = [name for *_, name in steps]
    keyed = events.select(
        F.when(F.col("event_name").isin(names), F.col("user_id")).alias("user_id"), "event_name"
    )
    return user_funnel_flags(keyed, steps)


def _funnel_totals(events: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """One row: users reaching each step (``n_<flag>``) and their share of step 1."""
    return _totals_from_flags(flags_for_totals(events, steps), steps)


def _totals_from_flags(flags: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """``n_<flag>``: users per step; ``r_<flag>``: their share of step 1 (1 decimal, step 1 = 100)."""
    sums = [f"CAST(sum({col}) AS BIGINT) AS n_{col}" for _, _, col, _ in steps]
    base = f"n_{steps[0][2]}"
    rates = [f"100.0D AS r_{steps[0][2]}"] + [f"{pct_sql(f'n_{col}', base, 1)} AS r_{col}" for _, _, col, _ in steps[1:]]
    return flags.selectExpr(*sums).selectExpr("*", *rates)


def _step_rows(wide: DataFrame, steps: Sequence[Step], fields) -> DataFrame:
    """Unpivot the single wide row into one row per step; ``fields`` are (name, SQL per step)."""
    rows = [[expr(i, step) for _, expr in fields] for i, step in enumerate(steps)]
    return stack_rows(wide, rows, [name for name, _ in fields])


def dropoff_sql(steps: Sequence[Step], i: int) -> str:
    """drop_off_rate of step i: 100 - next step's share of sign-ups; 0 for the last step."""
    if i + 1 >= len(steps):
        return "0.0D"
    return f"coalesce(100.0D - r_{steps[i + 1][2]}, 0.0D)"


STEP_FIELDS = [
    ("funnel_step", lambda i, s: lit_sql(s[1])),
    ("step_number", lambda i, s: lit_sql(s[0])),
    ("user_count", lambda i, s: f"n_{s[2]}"),
    ("conversion_rate", lambda i, s: f"r_{s[2]}"),
]


def funnel_steps(events: DataFrame, steps: Sequence[Step] = FUNNEL_STEPS) -> DataFrame:
    """O2: ``funnel_step, step_number, user_count, conversion_rate`` (share of step 1, 1 decimal)."""
    return funnel_steps_from_flags(flags_for_totals(events, steps), steps)


def funnel_steps_from_flags(flags: DataFrame, steps: Sequence[Step] = FUNNEL_STEPS) -> DataFrame:
    """O2 from an O1-shaped table of per-user flags (one row per user)."""
    return _step_rows(_totals_from_flags(flags, steps), steps, STEP_FIELDS)


def funnel_dropoff(events: DataFrame, steps: Sequence[Step] = FUNNEL_STEPS) -> DataFrame:
    """O3: O2 plus ``drop_off_rate = 100 - conversion_rate of the next step`` (last step 0).

    Computed on the single aggregated row, so no window (and no single-partition
    exchange) is needed.
    """
    return funnel_dropoff_from_flags(flags_for_totals(events, steps), steps)


def funnel_dropoff_from_flags(flags: DataFrame, steps: Sequence[Step] = FUNNEL_STEPS) -> DataFrame:
    """O3 from an O1-shaped table of per-user flags."""
    fields = STEP_FIELDS + [("drop_off_rate", lambda i, s: dropoff_sql(steps, i))]
    return _step_rows(_totals_from_flags(flags, steps), steps, fields)


def funnel_biggest_dropoff(events: DataFrame, steps: Sequence[Step] = FUNNEL_STEPS) -> DataFrame:
    """The step with the largest drop-off; the earliest step wins ties (top-1 of five rows)."""
    return (
        funnel_dropoff(events, steps)
        .orderBy(F.col("drop_off_rate").desc(), F.col("step_number").asc())
        .limit(1)
    )


def funnel_dropoff_positive(events: DataFrame, steps: Sequence[Step] = FUNNEL_STEPS) -> DataFrame:
    """Steps whose drop-off is above zero."""
    return funnel_dropoff(events, steps).where(F.col("drop_off_rate") > 0)


def funnel_kpis(events: DataFrame, steps: Sequence[Step] = FUNNEL_STEPS) -> DataFrame:
    """Headline numbers of the funnel page in one row.

    Users at steps 1, 2, 3 and the last step, and the share of sign-ups for steps
    2, 3 and the last step.
    """
    s1, s2, s3, last = steps[0][2], steps[1][2], steps[2][2], steps[-1][2]
    return _funnel_totals(events, steps).selectExpr(
        f"n_{s1} AS signed_up_users",
        f"n_{s2} AS activated_users",
        f"r_{s2} AS activation_rate",
        f"n_{s3} AS invited_users",
        f"r_{s3} AS invite_rate",
        f"n_{last} AS converted_users",
        f"r_{last} AS overall_conversion_rate",
    )


def funnel_step_over_step(events: DataFrame, steps: Sequence[Step] = FUNNEL_STEPS) -> DataFrame:
    """Each step's users as a share of the previous step's users, and the complement.

    ``step_conversion = round(100 * n_k / n_(k-1), 1)``, ``step_dropoff = round(100 - that, 1)``;
    one row per transition (steps 2..last), NULL when the previous step has no users.
    """
    rows = []
    for prev, cur in zip(steps, steps[1:]):
        exact = pct_sql(f"n_{cur[2]}", f"n_{prev[2]}")
        rows.append(
            [
                lit_sql(cur[0]),
                lit_sql(cur[1]),
                f"n_{prev[2]}",
                f"n_{cur[2]}",
                f"round({exact}, 1)",
                f"round(100.0D - {exact}, 1)",
            ]
        )
    names = ["step_number", "funnel_step", "previous_count", "user_count", "step_conversion", "step_dropoff"]
    return stack_rows(_funnel_totals(events, steps), rows, names)


def funnel_share_of_active(events: DataFrame, steps: Sequence[Step] = FUNNEL_STEPS, step: int = 2) -> DataFrame:
    """Users reaching ``step`` over all users with any event (1 decimal)."""
    col = steps[step - 1][2]
    return user_funnel_flags(events, steps).selectExpr(
        f"CAST(sum({col}) AS BIGINT) AS users_{col}",
        f"{pct_sql(f'sum({col})', 'count(1)', 1)} AS conversion_rate",
    )
