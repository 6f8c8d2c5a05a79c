"""How many users an A/B test needs, and the power it has now, from the exposed users' conversion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from trailmark.functions.sqlexpr import lit_sql, stack_rows
from trailmark.functions.stats import normal_cdf_sql, normal_quantile_sql
from trailmark.operators.abtest import ab_test_summary, _ab_wide
from trailmark.schemas import AB_CONTROL, AB_TREATMENT, ALPHA

POWER = 0.8
DIFFERENCES = (3.0, 4.0)  # points


def power_plan_from_summary(
    summary: DataFrame,
    differences: Sequence[float] = DIFFERENCES,
    power: float = POWER,
    alpha: float = ALPHA,
    control: str = AB_CONTROL,
    treatment: str = AB_TREATMENT,
) -> DataFrame:
    """X1 from an O9-shaped summary (see ``ab_power_plan``)."""
    wide = _ab_wide(summary, control, treatment)
    rows = [["'observed'", "b_rate - a_rate"], *([lit_sql(f"{d:g} points"), lit_sql(float(d))] for d in differences)]
    fixed = ["a_rate", "a_total", "b_total"]
    plan = stack_rows(wide, [[*r, *fixed] for r in rows], ["difference", "difference_pp", "control_rate", "n_a", "n_b"])
    plan = plan.selectExpr(
        "*",
        "control_rate + difference_pp AS target_rate",
        "control_rate / 100.0D AS p1",
        "(control_rate + difference_pp) / 100.0D AS p2",
    ).selectExpr(
        "*",
        "CASE WHEN difference_pp <> 0 AND target_rate BETWEEN 0 AND 100 THEN p1 * (1 - p1) + p2 * (1 - p2) END AS spread",
        "CASE WHEN difference_pp <> 0 AND target_rate BETWEEN 0 AND 100 THEN"
        " p1 * (1 - p1) / nullif(n_a, 0) + p2 * (1 - p2) / nullif(n_b, 0) END AS variance_now",
        f"{normal_quantile_sql(lit_sql(1 - float(alpha) / 2))} AS z_alpha",
        f"{normal_quantile_sql(lit_sql(float(power)))} AS z_power",
    )
    plan = plan.selectExpr(
        "*",
        "CAST(ceil((z_alpha + z_power) * (z_alpha + z_power) * spread / ((p2 - p1) * (p2 - p1))) AS BIGINT) AS per_arm",
        "abs(p2 - p1) / nullif(sqrt(variance_now), 0) - z_alpha AS reach",
    )
    return plan.selectExpr(
        "difference",
        "difference_pp",
        "control_rate",
        "target_rate",
        "per_arm",
        "2 * per_arm AS total",
        "least(n_a, n_b) AS smaller_arm_now",
        "least(n_a, n_b) >= per_arm AS enough_now",
        f"round({normal_cdf_sql('reach')}, 4) AS power_now",
    )


def ab_power_plan(
    users: DataFrame,
    events: DataFrame,
    differences: Sequence[float] = DIFFERENCES,
    power: float = POWER,
    alpha: float = ALPHA,
    control: str = AB_CONTROL,
    treatment: str = AB_TREATMENT,
) -> DataFrame:
    """Exposed users needed per arm to detect a difference with ``power`` at two-sided ``alpha``.

    One row for the observed difference of the rates and one for each of ``differences`` (points over the
    control rate): (z_(1-alpha/2) + z_power)^2 (p1 q1 + p2 q2) / (p1 - p2)^2, rounded up. ``power_now`` is the
    chance that the exposed users there are would show that difference. NULL for a difference of zero, a
    target rate outside 0 to 100, or a missing group. Rates have 2 decimals, as in O9.
    """
    return power_plan_from_summary(ab_test_summary(users, events), differences, power, alpha, control, treatment)
