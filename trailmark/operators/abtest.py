"""A/B test read-out: exposed users, conversion per group, lift and chi-squared test.

Plan shape: the event log is reduced to one row per user *before* it meets the
users table (map-side combined, so a heavy user is one row per map task), and
the join then runs on the same ``user_id`` hash partitioning on both sides.
Everything after the per-group aggregate works on at most a few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.frames import sort_few
from trailmark.functions.sqlexpr import bitmask_agg, lit_sql, unpack_bits
from trailmark.functions.stats import with_chi2_2x2
from trailmark.schemas import AB_CONTROL, AB_CONVERSION_EVENT, AB_EXPOSURE_EVENT, AB_TREATMENT, ALPHA


def _event_flags(events: DataFrame, exposure: str, conversion: str) -> DataFrame:
    """Per user: 0/1 exposure and conversion flags, from the two relevant events only."""
    relevant = events.where(F.col("event_name").isin(exposure, conversion) & F.col("user_id").isNotNull())
    masks = relevant.groupBy("user_id").agg(bitmask_agg("event_name", [exposure, conversion], "flag_mask"))
    return masks.selectExpr("user_id", *unpack_bits("flag_mask", ["viewed_pricing", "converted"]))


def ab_user_conversions(
    users: DataFrame,
    events: DataFrame,
    exposure: str = AB_EXPOSURE_EVENT,
    conversion: str = AB_CONVERSION_EVENT,
) -> DataFrame:
    """Every user with group and 0/1 ``viewed_pricing`` / ``converted`` (0 without events).

    Same result as grouping a users LEFT JOIN events by (user, group), computed as
    pre-aggregated flags LEFT-joined to users. The final group-by only merges
    duplicate (user, group) rows and reuses the join's partitioning.
    """
    flags = _event_flags(events, exposure, conversion)
    joined = users.select("user_id", "ab_test_group").join(flags, "user_id", "left")
    return joined.groupBy("user_id", "ab_test_group").agg(
        F.coalesce(F.max("viewed_pricing"), F.lit(0)).alias("viewed_pricing"),
        F.coalesce(F.max("converted"), F.lit(0)).alias("converted"),
    )


def ab_pricing_viewers(
    users: DataFrame,
    events: DataFrame,
    exposure: str = AB_EXPOSURE_EVENT,
    conversion: str = AB_CONVERSION_EVENT,
) -> DataFrame:
    """Users exposed to the test (``viewed_pricing = 1``).

    An exposed user must have an exposure event, so the join to users is inner and
    happens after non-viewers are dropped: Catalyst does not make this rewrite
    by itself (the filter sits above an aggregate).
    """
    return _viewers(users, _event_flags(events, exposure, conversion))


def _viewers(users: DataFrame, flags: DataFrame) -> DataFrame:
    """Exposed users with their group: per-user flags filtered first, then inner-joined."""
    exposed = flags.where((F.col("viewed_pricing") == 1) & F.col("user_id").isNotNull())
    joined = users.select("user_id", "ab_test_group").join(exposed, "user_id", "inner")
    return joined.groupBy("user_id", "ab_test_group").agg(
        F.max("viewed_pricing").alias("viewed_pricing"),
        F.max("converted").alias("converted"),
    )


def ab_test_summary(
    users: DataFrame,
    events: DataFrame,
    exposure: str = AB_EXPOSURE_EVENT,
    conversion: str = AB_CONVERSION_EVENT,
) -> DataFrame:
    """Per group: exposed users, conversions, conversion rate (%, 2 decimals)."""
    return _summarize(ab_pricing_viewers(users, events, exposure, conversion))


def ab_test_summary_from_flags(users: DataFrame, flags: DataFrame) -> DataFrame:
    """O9 from per-user ``viewed_pricing`` / ``converted`` flags computed elsewhere
    (e.g. the funnel's per-user table), so one pass over the events serves both."""
    return _summarize(_viewers(users, flags))


def _summarize(viewers: DataFrame) -> DataFrame:
    per_group = viewers.groupBy("ab_test_group").agg(
        F.count(F.lit(1)).alias("total_users"), F.sum("converted").cast("long").alias("conversions")
    )
    summary = per_group.selectExpr(
        "ab_test_group",
        "total_users",
        "conversions",
        "round(100.0D * conversions / total_users, 2) AS conversion_rate",
    )
    return sort_few(summary, F.col("ab_test_group").asc_nulls_last())


def _ab_wide(summary: DataFrame, control: str, treatment: str) -> DataFrame:
    """The two groups' rows of O9 side by side in one row (conditional aggregates)."""
    picks = []
    for prefix, group in (("a", control), ("b", treatment)):
        for col, short in (("total_users", "total"), ("conversions", "conv"), ("conversion_rate", "rate")):
            picks.append(f"max(CASE WHEN ab_test_group = {lit_sql(group)} THEN {col} END) AS {prefix}_{short}")
    return summary.selectExpr(*picks)


def contingency_from_summary(summary: DataFrame, control: str = AB_CONTROL, treatment: str = AB_TREATMENT) -> DataFrame:
    """The 2x2 table of an O9-shaped summary as one row."""
    return _ab_wide(summary, control, treatment).selectExpr(
        "a_conv AS a_conversions",
        "a_total - a_conv AS a_non_conversions",
        "b_conv AS b_conversions",
        "b_total - b_conv AS b_non_conversions",
    )


def chi2_from_summary(
    summary: DataFrame,
    control: str = AB_CONTROL,
    treatment: str = AB_TREATMENT,
    alpha: float = ALPHA,
    yates: bool = True,
) -> DataFrame:
    """The chi-squared test of an O9-shaped summary (see ``ab_chi2_test``)."""
    t = contingency_from_summary(summary, control, treatment)
    test = with_chi2_2x2(t, "a_conversions", "a_non_conversions", "b_conversions", "b_non_conversions", yates=yates)
    return test.selectExpr(
        "round(chi2, 4) AS chi2",
        "round(p_value, 4) AS p_value",
        "dof",
        "expected_a_conv",
        "expected_a_non",
        "expected_b_conv",
        "expected_b_non",
        f"p_value < {lit_sql(float(alpha))} AS significant",
    )


def lift_from_summary(summary: DataFrame, control: str = AB_CONTROL, treatment: str = AB_TREATMENT) -> DataFrame:
    """Relative lift (%) from the 2-decimal rates of an O9-shaped summary, and lift in points."""
    return _ab_wide(summary, control, treatment).selectExpr(
        "a_rate AS control_rate",
        "b_rate AS treatment_rate",
        "try_divide(b_rate - a_rate, a_rate) * 100.0D AS lift_pct",
        "b_rate - a_rate AS lift_pp",
    )


def ab_contingency(
    users: DataFrame, events: DataFrame, control: str = AB_CONTROL, treatment: str = AB_TREATMENT
) -> DataFrame:
    """The 2x2 table [[conv A, non-conv A], [conv B, non-conv B]] as one row."""
    return contingency_from_summary(ab_test_summary(users, events), control, treatment)


def ab_chi2_test(
    users: DataFrame,
    events: DataFrame,
    control: str = AB_CONTROL,
    treatment: str = AB_TREATMENT,
    alpha: float = ALPHA,
    yates: bool = True,
) -> DataFrame:
    """Chi-squared test of independence on the 2x2 table (continuity-corrected).

    ``chi2`` and ``p_value`` are rounded to 4 decimals (the reported precision);
    ``significant`` compares the unrounded p-value with ``alpha``. All NULL when
    a group is missing or an expected count is zero.
    """
    return chi2_from_summary(ab_test_summary(users, events), control, treatment, alpha, yates)


def ab_lift(
    users: DataFrame, events: DataFrame, control: str = AB_CONTROL, treatment: str = AB_TREATMENT
) -> DataFrame:
    """Relative lift (%) of treatment over control from the 2-decimal rates, and lift in points."""
    return lift_from_summary(ab_test_summary(users, events), control, treatment)


def ab_sample_size(
    users: DataFrame, events: DataFrame, control: str = AB_CONTROL, treatment: str = AB_TREATMENT
) -> DataFrame:
    """Exposed users across the two groups."""
    w = _ab_wide(ab_test_summary(users, events), control, treatment)
    return w.selectExpr("a_total + b_total AS sample_size")
