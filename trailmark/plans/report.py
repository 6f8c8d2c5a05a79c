"""The analysis report: funnel, A/B test and retention results from shared intermediates.

The funnel and the A/B test both need per-user flags; the report computes them
once (one scan and one ``user_id`` shuffle of the event log) and feeds both.
Retention needs one more pass. Every other output is derived from these small
intermediates. With ``materialize=True`` the intermediates are checkpointed to
``spark.checkpoint.dir``, so the outputs never go back to the raw events and a
lost executor never forces recomputation from them. Single-row parts are put
side by side with a union and one aggregate, not with joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.frames import side_by_side
from trailmark.functions.sqlexpr import bitmask_agg, lit_sql, pct_sql, unpack_bits
from trailmark.functions.stats import with_chi2_2x2
from trailmark.operators import abtest, funnel, retention
from trailmark.operators.retention import Labeler
from trailmark.schemas import (
    AB_CONTROL,
    AB_TREATMENT,
    ACTIVITY_EVENT,
    ALPHA,
    BASELINE_COHORT,
    COMPARISON_COHORT,
    FUNNEL_STEPS,
)
from trailmark.session import materialize as checkpoint_df


def analysis_tables(
    users: DataFrame,
    events: DataFrame,
    labeler: Labeler | None = None,
    baseline: str = BASELINE_COHORT,
    comparison: str = COMPARISON_COHORT,
    alpha: float = ALPHA,
    materialize: bool = False,
    materialize_shared: bool | None = None,
) -> dict[str, DataFrame]:
    """All report outputs, sharing two passes over the event log.

    ``funnel`` (O3), ``ab_test_summary`` (O9), ``ab_chi2_test`` (O11), ``ab_lift``
    (O12), ``cohort_retention`` (O17), ``retention_comparison`` (O21) and
    ``summary`` (one row of headline numbers). ``materialize`` checkpoints the
    per-user flags; ``materialize_shared`` (default: same) also checkpoints the
    small A/B summary and cohort table that several outputs read, which pays off
    when more than one output is computed.
    """
    if materialize_shared is None:
        materialize_shared = materialize

    def keep(df: DataFrame, flag: bool) -> DataFrame:
        return checkpoint_df(df) if flag else df

    # step sums and the A/B flags of exposed users are all the report needs per user
    flags = keep(funnel.flags_for_totals(events), materialize)
    dropoff = funnel.funnel_dropoff_from_flags(flags)
    ab_flags = flags.select("user_id", "viewed_pricing", F.col("upgraded").alias("converted"))
    summary = keep(abtest.ab_test_summary_from_flags(users, ab_flags), materialize_shared)
    test = abtest.chi2_from_summary(summary, alpha=alpha)
    lift = abtest.lift_from_summary(summary)
    cohorts = keep(retention.cohort_retention(users, events, labeler), materialize_shared)

    biggest = (
        dropoff.orderBy(F.col("drop_off_rate").desc(), F.col("step_number").asc())
        .limit(1)
        .selectExpr("funnel_step AS biggest_dropoff_step", "drop_off_rate AS biggest_dropoff_rate")
    )
    rates = dropoff.selectExpr(
        "max(CASE WHEN step_number = 3 THEN conversion_rate END) AS invite_rate",
        "max(CASE WHEN step_number = 5 THEN conversion_rate END) AS overall_conversion_rate",
    )
    headline = side_by_side(
        biggest,
        rates,
        lift.select("lift_pct"),
        test.select("p_value", "significant"),
        retention.improvement_from_retention(cohorts, baseline, comparison),
    )
    return {
        "funnel": dropoff,
        "ab_test_summary": summary,
        "ab_chi2_test": test,
        "ab_lift": lift,
        "cohort_retention": cohorts,
        "retention_comparison": retention.comparison_from_retention(cohorts, baseline, comparison),
        "summary": headline,
    }


def _dropoff(step: int) -> str:
    """100 minus the next step's share of sign-ups, 0 for the last step."""
    return "0.0D" if step == len(FUNNEL_STEPS) else f"coalesce(100.0D - r_{step + 1}, 0.0D)"


def _summary_counts(
    users: DataFrame, events: DataFrame, labeler: Labeler, baseline: str, comparison: str
) -> DataFrame:
    """One row with every count that the summary needs, from one row per user.

    Events are reduced to a step mask and the set of active dates per user (one scan, one shuffle) and meet
    the users once; repeated rows of a user are folded before. The rest is one global aggregate.
    """
    active = F.when((F.col("event_name") == F.lit(ACTIVITY_EVENT)) & F.col("user_id").isNotNull(), F.to_date("event_timestamp"))
    did = events.groupBy("user_id").agg(
        bitmask_agg("event_name", [name for *_, name in FUNNEL_STEPS], "m"), F.collect_set(active).alias("active")
    )
    who = users.groupBy("user_id").agg(
        F.collect_set("ab_test_group").alias("groups"), F.collect_set(F.col("sign_up_date").cast("date")).alias("signed")
    )
    flags = unpack_bits("m", [c for _, _, c, _ in FUNNEL_STEPS])
    per_user = did.selectExpr("user_id", "active", *flags).join(who, "user_id", "left")

    def in_cohort(cohort: str, day: int | None = None):
        def member(date):
            ok = labeler(date) == F.lit(cohort)
            return ok if day is None else ok & F.array_contains(F.col("active"), F.date_add(date, day))

        return (F.size("active") > 0) & F.exists("signed", member)

    counts = {f"n_{c}": F.sum(c).cast("long") for _, _, c, _ in FUNNEL_STEPS}
    for arm, group in (("a", AB_CONTROL), ("b", AB_TREATMENT)):
        exposed = (F.col("viewed_pricing") == 1) & F.array_contains("groups", F.lit(group))
        counts[f"{arm}_total"] = F.count_if(exposed)
        counts[f"{arm}_conv"] = F.count_if(exposed & (F.col("upgraded") == 1))
    for name, cohort in (("base", baseline), ("comp", comparison)):
        counts[f"{name}_size"] = F.count_if(in_cohort(cohort))
        for day in (1, 7):
            counts[f"{name}_{day}"] = F.count_if(in_cohort(cohort, day))
    return per_user.agg(*[c.alias(name) for name, c in counts.items()])


def executive_summary(
    users: DataFrame,
    events: DataFrame,
    labeler: Labeler | None = None,
    baseline: str = BASELINE_COHORT,
    comparison: str = COMPARISON_COHORT,
    alpha: float = ALPHA,
    materialize: bool = False,
) -> DataFrame:
    """One row: biggest drop-off (step, rate), invite and overall conversion rates,
    A/B lift and p-value with its significance, and the comparison cohort's day-7 /
    day-1 retention change against the baseline cohort.

    The same numbers as ``analysis_tables`` has in ``summary``, from one aggregate of the users; with
    ``materialize`` from its checkpointed tables.
    """
    if materialize:
        return analysis_tables(users, events, labeler, baseline, comparison, alpha, True, materialize_shared=False)["summary"]
    labeler = labeler or retention.month_cohorts()
    t = _summary_counts(users, events, labeler, baseline, comparison)
    first = FUNNEL_STEPS[0][2]
    rates = ["100.0D AS r_1"] + [f"{pct_sql(f'n_{c}', f'n_{first}', 1)} AS r_{i}" for i, _, c, _ in FUNNEL_STEPS[1:]]
    arms = [
        expr
        for arm in ("a", "b")
        # a group without exposed users has no row in the test
        for expr in (
            f"nullif({arm}_total, 0) AS {arm}_n",
            f"CASE WHEN {arm}_total > 0 THEN {arm}_conv END AS {arm}_yes",
            f"{pct_sql(f'{arm}_conv', f'{arm}_total', 2)} AS {arm}_rate",
        )
    ]
    cohorts = [f"{pct_sql(f'{c}_{d}', f'{c}_size', 1)} AS {c}_rate_{d}" for c in ("base", "comp") for d in (1, 7)]
    t = t.selectExpr(*rates, *arms, *cohorts)
    t = t.selectExpr("*", "a_n - a_yes AS a_no", "b_n - b_yes AS b_no")
    t = with_chi2_2x2(t, "a_yes", "a_no", "b_yes", "b_no")
    # the earliest step wins ties
    steps = ", ".join(
        f"struct({_dropoff(i)} AS rate, {-i} AS later, {lit_sql(label)} AS step)" for i, label, *_ in FUNNEL_STEPS
    )
    t = t.selectExpr("*", f"array_max(array({steps})) AS biggest")
    return t.selectExpr(
        "biggest.step AS biggest_dropoff_step",
        "biggest.rate AS biggest_dropoff_rate",
        "r_3 AS invite_rate",
        "r_5 AS overall_conversion_rate",
        "try_divide(b_rate - a_rate, a_rate) * 100.0D AS lift_pct",
        "round(p_value, 4) AS p_value",
        f"p_value < {lit_sql(float(alpha))} AS significant",
        "comp_rate_7 - base_rate_7 AS day_7_improvement",
        "comp_rate_1 - base_rate_1 AS day_1_improvement",
    )
