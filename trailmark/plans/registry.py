"""Named queries over the shared test tables: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the given parquet tables through the mapping A / B adapters, which
keep every row, and runs one operator on them. Sources are read anew for each call, so
new files are seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark import schemas as S
from trailmark.operators import abtest, funnel, inviters, kpis, maturity, power, retention, segments, weekly
from trailmark.plans import report
from trailmark.sources import counts, fixtures, keyed, quarantine, times
from trailmark.sources.fixtures import load_mapping_a, load_mapping_b, split_cohorts

Query = Callable[[SparkSession, str], DataFrame]

# Registry parameters (fixed so that the Spark and SQL sides agree).
USERS_FILTER = {"plans": ["Paid"], "groups": ["A", "B"], "months": [1]}
EVENTS_FILTER = {"event_types": ["created_project", "invited_teammate"], "user_id_text": "7"}
COUNTED = ("customer", "documents", "embeddings", "events", "lineitem", "orders")
SPLIT_BASELINE, SPLIT_COMPARISON = "before", "after"


def _on_events(op) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, events = load_mapping_a(spark, sf_dir)
        return op(events)

    return run


def _on_users(op) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        users, _ = load_mapping_a(spark, sf_dir)
        return op(users)

    return run


def _on_both(op) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        users, events = load_mapping_a(spark, sf_dir)
        return op(users, events)

    return run


def _split(op, **kw) -> Query:
    """Retention operator on mapping A with the before / after sign-up split."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        users, events = load_mapping_a(spark, sf_dir)
        return op(users, events, labeler=split_cohorts(), **kw)

    return run


def _month(op, **kw) -> Query:
    """Retention operator on mapping B with the literal sign-up-month cohorts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        users, events = load_mapping_b(spark, sf_dir)
        return op(users, events, **kw)

    return run


def _on_journeys(op) -> Query:
    """Retention on mapping B's journey table, with the literal sign-up-month cohorts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(fixtures.load_journeys_b(spark, sf_dir))

    return run


def _journey_retention(journeys: DataFrame) -> DataFrame:
    return retention.retention_from_flags(retention.journey_flags(journeys))


def _month_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    users, _ = load_mapping_b(spark, sf_dir)
    return retention.user_cohorts(users)


def _split_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    users, _ = load_mapping_a(spark, sf_dir)
    return retention.user_cohorts(users, split_cohorts())


def _checked_lines(events: DataFrame) -> DataFrame:
    return quarantine.checked_lines(fixtures.damaged_lines(events), S.EVENTS, list(fixtures.EVENT_FIELDS))


def _read_times(events: DataFrame) -> DataFrame:
    return times.read_times(fixtures.mixed_times(events), "event_timestamp")


def _row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.input_row_counts(spark, {name: f"{sf_dir.rstrip('/')}/{name}.parquet" for name in COUNTED})


def _keyed_flags(events: DataFrame) -> DataFrame:
    return funnel.user_funnel_flags(keyed.keyed_copy(events, fixtures.KEYED_BUCKETS))


def _keyed_period_flags(events: DataFrame) -> DataFrame:
    date = F.col(keyed.DATE)
    kept = keyed.keyed_copy(events, fixtures.KEYED_BUCKETS)
    return funnel.user_funnel_flags(kept.where((date >= fixtures.KEYED_SINCE) & (date < fixtures.KEYED_UNTIL)))


QUERIES: dict[str, Query] = {
    # funnel
    "user_funnel_flags": _on_events(funnel.user_funnel_flags),
    "funnel_steps": _on_events(funnel.funnel_steps),
    "funnel_dropoff": _on_events(funnel.funnel_dropoff),
    "funnel_biggest_dropoff": _on_events(funnel.funnel_biggest_dropoff),
    "funnel_dropoff_positive": _on_events(funnel.funnel_dropoff_positive),
    "funnel_kpis": _on_events(funnel.funnel_kpis),
    "funnel_step_over_step": _on_events(funnel.funnel_step_over_step),
    "funnel_share_of_active": _on_events(funnel.funnel_share_of_active),
    # A/B test
    "ab_user_conversions": _on_both(abtest.ab_user_conversions),
    "ab_pricing_viewers": _on_both(abtest.ab_pricing_viewers),
    "ab_test_summary": _on_both(abtest.ab_test_summary),
    "ab_contingency": _on_both(abtest.ab_contingency),
    "ab_chi2_test": _on_both(abtest.ab_chi2_test),
    "ab_lift": _on_both(abtest.ab_lift),
    "ab_sample_size": _on_both(abtest.ab_sample_size),
    # retention, mapping A (before / after split)
    "user_cohorts": _split_cohorts,
    "user_activity": _split(retention.user_activity),
    "user_retention_flags": _split(retention.user_retention_flags),
    "cohort_retention": _split(retention.cohort_retention),
    "retention_matrix": _split(retention.retention_matrix),
    "retention_curve": _split(retention.retention_curve),
    "retention_improvement": _split(
        retention.retention_improvement, baseline=SPLIT_BASELINE, comparison=SPLIT_COMPARISON
    ),
    "retention_comparison": _split(
        retention.retention_comparison, baseline=SPLIT_BASELINE, comparison=SPLIT_COMPARISON
    ),
    "retention_ratio_doc": _split(retention.retention_ratio_doc),
    # retention, mapping B (literal month cohorts incl. NULL, orders x lineitem)
    "user_cohorts_month": _month_cohorts,
    "user_activity_month": _month(retention.user_activity, activity_event="used_feature_X"),
    "cohort_retention_month": _on_journeys(_journey_retention),
    "retention_comparison_month": _on_journeys(lambda j: retention.comparison_from_retention(_journey_retention(j))),
    "retention_ratio_doc_month": _on_journeys(retention.journey_ratio_doc),
    # the analysis report's headline numbers (mapping A, before / after split)
    "executive_summary": _split(
        report.executive_summary, baseline=SPLIT_BASELINE, comparison=SPLIT_COMPARISON
    ),
    # retention over users observed long enough
    "mature_retention": _split(maturity.mature_retention),
    "mature_retention_month": _month(maturity.mature_retention),
    "mature_retention_comparison": _split(
        maturity.mature_retention_comparison, baseline=SPLIT_BASELINE, comparison=SPLIT_COMPARISON
    ),
    "mature_retention_comparison_month": _month(maturity.mature_retention_comparison),
    # the funnel by segment
    "funnel_by_segment": _split(segments.funnel_by_segment),
    "funnel_by_segment_cube": _split(segments.funnel_by_segment, sets=segments.cube_sets(segments.SEGMENTS)),
    # inviters against others, sample sizes, weekly KPIs
    "conversion_by_invite": _on_events(inviters.conversion_by_invite),
    "conversion_by_invite_activated": _on_events(
        lambda e: inviters.conversion_by_invite(e, base_event=S.CREATED_PROJECT)
    ),
    "invite_risk_ratio": _on_events(inviters.invite_risk_ratio),
    "ab_power_plan": _on_both(power.ab_power_plan),
    "weekly_kpis": _on_both(weekly.weekly_kpis),
    "weekly_kpis_orders": _month(weekly.weekly_kpis),
    # sources: records kept apart, times in several forms, footer counts, a keyed table
    "events_accepted": _on_events(lambda e: quarantine.valid_rows(_checked_lines(e), S.EVENTS)),
    "events_rejected": _on_events(lambda e: quarantine.rejected_rows(_checked_lines(e))),
    "events_line_outcomes": _on_events(lambda e: quarantine.rejections(_checked_lines(e))),
    "event_times_read": _on_events(_read_times),
    "event_time_forms": _on_events(lambda e: times.time_forms(_read_times(e), "event_timestamp")),
    "input_row_counts": _row_counts,
    "keyed_user_funnel_flags": _on_events(_keyed_flags),
    "keyed_period_funnel_flags": _on_events(_keyed_period_flags),
    # KPIs, series, explore
    "kpi_totals": _on_both(kpis.kpi_totals),
    "kpi_overview": _on_both(kpis.kpi_overview),
    "daily_signups": _on_users(kpis.daily_signups),
    "event_distribution": _on_events(kpis.event_distribution),
    "daily_events_by_type": _on_events(kpis.daily_events_by_type),
    "users_filtered": _on_users(lambda u: kpis.users_filtered(u, **USERS_FILTER)),
    "events_filtered": _on_events(lambda e: kpis.events_filtered(e, **EVENTS_FILTER)),
    "event_types": _on_events(kpis.event_types),
    "dataset_summary": _on_both(kpis.dataset_summary),
}
