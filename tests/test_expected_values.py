"""Values for the driver tables as listed in FIXTURES.md (computed independently there)."""

from __future__ import annotations

import pytest
from conftest import SF, rows

from trailmark.plans.registry import QUERIES

EXPECTED = {
    "0.001": {
        "funnel": [15, 12, 7, 11, 7],
        "rates": [80.0, 46.7, 73.3, 46.7],
        "ab": [("A", 6, 3, 50.0), ("B", 5, 2, 40.0)],
        "chi2": (0.0, 1.0),
        "lift": -20.0,
        "before": (9, 55.6, 22.2, 44.4, 0.0),
        "after": (6, 33.3, 33.3, 33.3, 0.0),
        "daily_rows": 195,
        "upgrades": 9,
        "month": {"Feb 2024": (24, 0.0, 0.0, 0.0, 4.2), "Jan 2024": (24, 0.0, 4.2, 0.0, 0.0), None: (102, 0.0, 2.0, 0.0, 3.9)},
    },
    "0.01": {
        "funnel": [150, 123, 75, 111, 67],
        "rates": [82.0, 50.0, 74.0, 44.7],
        "ab": [("A", 56, 27, 48.21), ("B", 55, 20, 36.36)],
        "chi2": (1.1477, 0.2840),
        "lift": -24.580,
        "before": (86, 39.5, 34.9, 22.1, 0.0),
        "after": (64, 18.8, 35.9, 23.4, 0.0),
        "daily_rows": 265,
        "upgrades": 85,
        "month": {"Feb 2024": (206, 1.0, 1.0, 0.5, 1.5), "Jan 2024": (222, 3.2, 2.3, 2.3, 0.5), None: (1072, 2.1, 1.4, 1.9, 2.2)},
    },
}


@pytest.mark.parametrize("sf", sorted(EXPECTED))
def test_fixture_values(spark, sf):
    exp, d, q = EXPECTED[sf], SF[sf], QUERIES
    steps = sorted(rows(q["funnel_steps"](spark, d), "step_number", "user_count", "conversion_rate"))
    assert [s[1] for s in steps] == exp["funnel"]
    assert [s[2] for s in steps[1:]] == exp["rates"]
    assert rows(q["ab_test_summary"](spark, d)) == exp["ab"]
    (t,) = q["ab_chi2_test"](spark, d).collect()
    assert (t.chi2, t.p_value) == pytest.approx(exp["chi2"], abs=1e-4)
    (lift,) = q["ab_lift"](spark, d).collect()
    assert lift.lift_pct == pytest.approx(exp["lift"], abs=1e-3)
    ret = {r[0]: r[1:] for r in rows(q["cohort_retention"](spark, d))}
    assert ret["before"] == exp["before"] and ret["after"] == exp["after"]
    assert q["daily_events_by_type"](spark, d).count() == exp["daily_rows"]
    assert q["kpi_overview"](spark, d).first().converted_events == exp["upgrades"]
    month = {r[0]: r[1:] for r in rows(q["cohort_retention_month"](spark, d))}
    assert month == exp["month"]


def test_invariants_sf001(spark):
    d, q = SF["0.01"], QUERIES
    total = q["kpi_totals"](spark, d).first()
    assert sum(r[1] for r in rows(q["event_distribution"](spark, d))) == total.total_events
    assert sum(r[1] for r in rows(q["daily_signups"](spark, d))) <= total.total_users
    for r in q["cohort_retention"](spark, d).collect():
        assert all(0.0 <= v <= 100.0 for v in r[2:])
    for r in q["ab_test_summary"](spark, d).collect():
        assert r.conversions <= r.total_users
    summary = q["dataset_summary"](spark, d).first()
    assert summary.free_users + summary.paid_users == summary.total_users
    assert summary.group_a_users + summary.group_b_users == summary.total_users
