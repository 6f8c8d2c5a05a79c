"""Physical-plan properties that matter at scale."""

from __future__ import annotations

import re

import pytest
from conftest import SF

from trailmark.plans.registry import QUERIES
from trailmark.operators import abtest, retention


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_in_plans(spark, name):
    p = plan(QUERIES[name](spark, SF["0.001"]))
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|PythonUDF|FlatMapGroupsInPandas|MapInPandas", p)


def test_funnel_scans_events_once(spark):
    p = plan(QUERIES["funnel_dropoff"](spark, SF["0.001"]))
    assert p.count("FileScan parquet") == 1
    # one shuffle on user_id, one to the single final partition, no window exchange
    assert "Window" not in p


def test_funnel_scan_prunes(spark):
    p = plan(QUERIES["funnel_steps"](spark, SF["0.001"]))
    assert "props" not in p and "event_id" not in p


def test_retention_has_no_outer_join(spark, make_users, make_events):
    users, events = make_users([]), make_events([])
    for op in (retention.cohort_retention, retention.user_activity, retention.retention_ratio_doc):
        assert "LeftOuter" not in optimized(op(users, events)), op.__name__
    from trailmark.sources.fixtures import load_mapping_b

    assert "LeftOuter" not in optimized(retention.cohort_retention(*load_mapping_b(spark, SF["0.001"])))


def test_ab_viewers_join_is_inner(make_users, make_events):
    users, events = make_users([]), make_events([])
    assert "LeftOuter" not in optimized(abtest.ab_test_summary(users, events))
    # the per-user read-out keeps users without events
    assert "LeftOuter" in optimized(abtest.ab_user_conversions(users, events))


def test_kpis_do_not_join(spark):
    for name in ("kpi_totals", "kpi_overview", "dataset_summary"):
        df = QUERIES[name](spark, SF["0.001"])
        # the users side comes from mapping A's own (event x customer) join; the
        # KPI itself must add none on top: one Union feeding one Aggregate
        top = optimized(df).split("Union")[0]
        assert "Join" not in top, name
        assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)


def test_retention_pre_aggregates_activity_before_join(spark):
    from trailmark.sources.fixtures import load_mapping_a, split_cohorts

    users, events = load_mapping_a(spark, SF["0.001"])
    df = retention.cohort_retention(users, events, split_cohorts())
    o = optimized(df)
    # the activity side of the join is an aggregate on (user_id, activity_date)
    join_at = o.index("Join Inner")
    assert "Aggregate [user_id" in o[join_at:]


def test_funnel_shuffles_one_mask_per_user(spark):
    p = re.sub(r"#\d+L?", "", plan(QUERIES["funnel_steps"](spark, SF["0.001"])))
    assert "partial_bit_or" in p and "partial_max" not in p
    # non-step rows are re-keyed to NULL before the per-user aggregate
    assert "CASE WHEN event_name IN (signed_up,created_project" in p
