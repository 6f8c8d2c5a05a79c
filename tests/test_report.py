from __future__ import annotations

from conftest import SF, rows

from trailmark.plans.registry import QUERIES
from trailmark.functions.frames import side_by_side
from trailmark.plans.report import executive_summary
from trailmark.sources.fixtures import load_mapping_a, split_cohorts


def test_side_by_side_without_join(spark):
    a = spark.createDataFrame([(1, "x")], "p long, q string")
    b = spark.createDataFrame([(2.5,)], "r double")
    df = side_by_side(a, b)
    assert rows(df) == [(1, "x", 2.5)]
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_summary_materialized_equals_lazy(spark):
    users, events = load_mapping_a(spark, SF["0.01"])
    lazy = executive_summary(users, events, split_cohorts(), "before", "after")
    kept = executive_summary(users, events, split_cohorts(), "before", "after", materialize=True)
    assert rows(lazy) == rows(kept)
    (r,) = lazy.collect()
    assert r.biggest_dropoff_step == "Step 4: Viewed Pricing" and r.biggest_dropoff_rate == 55.3
    assert (r.invite_rate, r.overall_conversion_rate, r.p_value, r.significant) == (50.0, 44.7, 0.284, False)
    # the materialized per-user table is read from the checkpoint, not from the event files
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan


def test_summary_consistent_with_parts(spark):
    q, d = QUERIES, SF["0.01"]
    (s,) = q["executive_summary"](spark, d).collect()
    (lift,) = q["ab_lift"](spark, d).collect()
    (imp,) = q["retention_improvement"](spark, d).collect()
    assert s.lift_pct == lift.lift_pct
    assert (s.day_7_improvement, s.day_1_improvement) == (imp.day_7_improvement, imp.day_1_improvement)


def test_materialized_report_never_rereads_events(spark, make_users, make_events):
    from trailmark.plans.report import analysis_tables
    from trailmark.operators.retention import date_split_cohorts
    import datetime as dt

    users = make_users([(1, dt.date(2024, 1, 1), "Free", "A"), (2, dt.date(2024, 1, 5), "Paid", "B")])
    events = make_events(
        [
            (1, "2024-01-01 00:00:00", "signed_up"),
            (1, "2024-01-02 00:00:00", "used_feature_X"),
            (2, "2024-01-05 00:00:00", "viewed_pricing_page"),
            (2, "2024-01-05 01:00:00", "upgraded_plan"),
        ]
    )
    tables = analysis_tables(users, events, date_split_cohorts(dt.date(2024, 1, 3)), "before", "after", materialize=True)
    for name, df in tables.items():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "event_name" not in plan, name
        assert df.count() >= 1


def test_lazy_summary_equals_the_parts_on_odd_tables(spark, make_users, make_events):
    """Repeated users, unknown ones, no sign-up date, a missing group, no activity."""
    import datetime as dt

    from trailmark.operators.retention import date_split_cohorts
    from trailmark.plans.report import analysis_tables

    d = dt.date
    users = [(1, d(2024, 1, 1), "Free", "A"), (1, d(2024, 1, 1), "Free", "A"), (1, d(2024, 1, 9), "Free", "B"), (2, None, "Free", "B")]
    users += [(3, d(2024, 1, 8), "Paid", "B"), (4, d(2024, 1, 2), "Free", None), (5, d(2024, 1, 2), "Free", "A")]
    log = [(u, "2024-01-01 00:00:00", "signed_up") for u in (1, 2, 3, 4, 9, None)]
    log += [(u, "2024-01-02 00:00:00", n) for u in (1, 3, 9) for n in ("viewed_pricing_page", "created_project", "used_feature_X")]
    log += [(3, "2024-01-09 10:00:00", "used_feature_X"), (5, "2024-01-09 10:00:00", "used_feature_X"), (3, "2024-01-09 10:00:00", "upgraded_plan")]
    for u, e in ((users, log), (users, []), ([], log), (users[:3], log), ([x for x in users if x[3] == "B"], log)):
        args = make_users(u), make_events(e), date_split_cohorts(d(2024, 1, 3)), "before", "after"
        assert rows(executive_summary(*args)) == rows(analysis_tables(*args)["summary"])


def test_summary_reads_each_table_once_for_users_and_once_for_events(spark):
    plan = QUERIES["executive_summary"](spark, SF["0.001"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 3


def test_month_retention_reads_orders_and_lines_once(spark):
    for name in ("cohort_retention_month", "retention_comparison_month", "retention_ratio_doc_month"):
        plan = QUERIES[name](spark, SF["0.001"])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 2, name
        assert plan.count("Exchange hashpartitioning") <= 3, name
