"""Randomised differential test: operators vs. the analysis's SQL shapes in DuckDB.

Random small users / events tables with NULL ids, NULL names and dates,
duplicate users, unknown users, activity before sign-up and across month ends.
"""

from __future__ import annotations

import datetime as dt

import duckdb
import pyarrow as pa
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tools.oracle_check import digest
from trailmark.operators import abtest, funnel, kpis, retention
from trailmark.plans.oracle import (
    MONTH_LABELS,
    MONTH_ON,
    ORACLE_SQL,
    SPLIT_BASE,
    SPLIT_LABELS,
    SPLIT_ON,
    _comparison,
    over_tables,
)
from trailmark.schemas import EVENTS, USERS
from trailmark.sources.fixtures import split_cohorts

NAMES = ["signed_up", "created_project", "invited_teammate", "viewed_pricing_page", "upgraded_plan", "used_feature_X"]
SPLIT = dict(labeler=split_cohorts())

OPS = {
    "user_funnel_flags": lambda u, e: funnel.user_funnel_flags(e),
    "funnel_steps": lambda u, e: funnel.funnel_steps(e),
    "funnel_dropoff": lambda u, e: funnel.funnel_dropoff(e),
    "funnel_biggest_dropoff": lambda u, e: funnel.funnel_biggest_dropoff(e),
    "funnel_kpis": lambda u, e: funnel.funnel_kpis(e),
    "funnel_step_over_step": lambda u, e: funnel.funnel_step_over_step(e),
    "funnel_share_of_active": lambda u, e: funnel.funnel_share_of_active(e),
    "ab_user_conversions": abtest.ab_user_conversions,
    "ab_pricing_viewers": abtest.ab_pricing_viewers,
    "ab_test_summary": abtest.ab_test_summary,
    "ab_chi2_test": abtest.ab_chi2_test,
    "ab_lift": abtest.ab_lift,
    "ab_sample_size": abtest.ab_sample_size,
    "user_activity": lambda u, e: retention.user_activity(u, e, **SPLIT),
    "user_retention_flags": lambda u, e: retention.user_retention_flags(u, e, **SPLIT),
    "cohort_retention": lambda u, e: retention.cohort_retention(u, e, **SPLIT),
    "retention_curve": lambda u, e: retention.retention_curve(u, e, **SPLIT),
    "retention_comparison": lambda u, e: retention.retention_comparison(u, e, baseline="before", comparison="after", **SPLIT),
    "retention_ratio_doc": lambda u, e: retention.retention_ratio_doc(u, e, **SPLIT),
    "cohort_retention_months": lambda u, e: retention.cohort_retention(u, e),
    "retention_comparison_months": lambda u, e: retention.retention_comparison(u, e),
    "retention_ratio_doc_months": lambda u, e: retention.retention_ratio_doc(u, e),
    "kpi_totals": kpis.kpi_totals,
    "kpi_overview": kpis.kpi_overview,
    "daily_signups": lambda u, e: kpis.daily_signups(u),
    "event_distribution": lambda u, e: kpis.event_distribution(e),
    "daily_events_by_type": lambda u, e: kpis.daily_events_by_type(e),
    "event_types": lambda u, e: kpis.event_types(e),
    "dataset_summary": kpis.dataset_summary,
}

DAY0 = dt.date(2023, 12, 28)
dates = st.one_of(st.none(), st.integers(0, 70).map(lambda n: DAY0 + dt.timedelta(days=n)))
stamps = st.tuples(st.integers(0, 100), st.integers(0, 86399)).map(
    lambda t: dt.datetime.combine(DAY0, dt.time()) + dt.timedelta(days=t[0], seconds=t[1])
)
user_rows = st.lists(
    st.tuples(
        st.one_of(st.none(), st.integers(1, 7)),
        dates,
        st.sampled_from(["Free", "Paid", None]),
        st.sampled_from(["A", "B", None]),
    ),
    max_size=9,
)
event_rows = st.lists(
    st.tuples(
        st.one_of(st.none(), st.integers(1, 9)),
        stamps,
        st.one_of(st.sampled_from(NAMES), st.sampled_from(NAMES), st.none()),
    ),
    max_size=40,
)


MONTH_BASE_PLAIN = SPLIT_BASE.replace(SPLIT_LABELS, MONTH_LABELS).replace(SPLIT_ON, MONTH_ON)
EXTRA_SQL = {
    "cohort_retention_months": MONTH_BASE_PLAIN + "\nSELECT * FROM cohort_retention",
    "retention_comparison_months": _comparison(MONTH_BASE_PLAIN, "Jan 2024", "Feb 2024"),
    "retention_ratio_doc_months": MONTH_BASE_PLAIN
    + """
SELECT cohort,
    SUM(CASE WHEN days_since_signup = 7 THEN 1 END) / COUNT(DISTINCT user_id) AS day_7_retention
FROM user_activity
GROUP BY cohort""",
}


def _arrow(urows, erows):
    users = pa.table(
        {
            "user_id": pa.array([r[0] for r in urows], pa.int64()),
            "sign_up_date": pa.array([r[1] for r in urows], pa.date32()),
            "plan_type": pa.array([r[2] for r in urows], pa.string()),
            "ab_test_group": pa.array([r[3] for r in urows], pa.string()),
        }
    )
    events = pa.table(
        {
            "event_id": pa.array(list(range(1, len(erows) + 1)), pa.int64()),
            "user_id": pa.array([r[0] for r in erows], pa.int64()),
            "event_timestamp": pa.array([r[1] for r in erows], pa.timestamp("us")),
            "event_name": pa.array([r[2] for r in erows], pa.string()),
        }
    )
    return users, events


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(user_rows, event_rows)
def test_operators_match_sql_on_random_tables(spark, urows, erows):
    u_arrow, e_arrow = _arrow(urows, erows)
    con = duckdb.connect()
    con.register("users", u_arrow)
    con.register("events", e_arrow)
    u = spark.createDataFrame([tuple(r) for r in urows], USERS)
    e = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(erows)], EVENTS)
    for name, op in OPS.items():
        df = op(u, e)
        s_rows = [tuple(r) for r in df.collect()]
        res = con.execute(over_tables(EXTRA_SQL.get(name) or ORACLE_SQL[name]))
        d_cols, d_rows = [c[0] for c in res.description], res.fetchall()
        assert sorted(df.columns) == sorted(d_cols), name
        assert digest(df.columns, s_rows)[1] == digest(d_cols, d_rows)[1], (name, urows, erows)
