"""Retention over users observed long enough."""

from __future__ import annotations

import re

import pytest
from conftest import SF, D, rows

from trailmark.operators import maturity, retention
from trailmark.plans.registry import QUERIES

USE = "used_feature_X"
USERS = [
    (1, D("2024-01-01"), "Free", "A"),  # observed for 30 days and more
    (2, D("2024-01-01"), "Free", "A"),  # no activity at all
    (3, D("2024-01-25"), "Paid", "B"),  # 14 days, not 30
    (4, D("2024-02-05"), "Free", "B"),  # 3 days
    (5, D("2024-02-08"), "Free", "A"),  # on the last day
    (6, D("2024-03-01"), "Free", "A"),  # after it
    (7, None, "Free", "A"),
    (None, D("2024-01-01"), "Free", "A"),  # can have no events
]
EVENTS = [
    (1, "2024-01-02 23:59:59", USE),
    (1, "2024-01-02 00:00:00", USE),  # twice on day 1
    (1, "2024-01-31 10:00:00", USE),  # day 30
    (1, "2023-12-31 10:00:00", USE),  # before sign-up
    (3, "2024-02-08 10:00:00", USE),  # day 14, the last day of the log
    (4, "2024-02-06 10:00:00", "created_project"),  # day 1, but no activity
    (9, "2024-02-02 10:00:00", USE),  # of no user
    (None, "2024-01-02 10:00:00", USE),
]


def _long(df):
    return {(r.cohort, r.day): (r.cohort_size, r.at_risk, r.retained, r.retention) for r in df.collect()}


def test_each_offset_has_its_own_denominator(make_users, make_events):
    got = _long(maturity.mature_retention(make_users(USERS), make_events(EVENTS)))
    assert got == {
        ("Jan 2024", 1): (4, 4, 1, 25.0),
        ("Jan 2024", 7): (4, 4, 0, 0.0),
        ("Jan 2024", 14): (4, 4, 1, 25.0),
        ("Jan 2024", 30): (4, 3, 1, 33.3),
        ("Feb 2024", 1): (2, 1, 0, 0.0),
        ("Feb 2024", 7): (2, 0, 0, None),
        ("Feb 2024", 14): (2, 0, 0, None),
        ("Feb 2024", 30): (2, 0, 0, None),
        (None, 1): (1, 0, 0, None),
        (None, 7): (1, 0, 0, None),
        (None, 14): (1, 0, 0, None),
        (None, 30): (1, 0, 0, None),
    }


@pytest.mark.parametrize("last", [(1, "2024-03-09 00:00:00", "upgraded_plan"), (99, "2024-03-09 00:00:00", USE), (None, "2024-03-09 00:00:00", "x")])
def test_any_event_ends_the_observation(make_users, make_events, last):
    """Also one that is no activity, of no user, or without a user."""
    got = _long(maturity.mature_retention(make_users(USERS), make_events([*EVENTS, last])))
    assert [got["Feb 2024", d][1] for d in (1, 7, 14, 30)] == [2, 2, 2, 2]
    assert [got[None, d][1:] for d in (1, 7, 14)] == [(1, 0, 0.0), (1, 0, 0.0), (0, 0, None)]


def test_comparison_is_null_where_a_cohort_is_too_young(make_users, make_events):
    got = {r.day: r for r in maturity.mature_retention_comparison(make_users(USERS), make_events(EVENTS)).collect()}
    assert (got[1].before_rate, got[1].after_rate, got[1].improvement, got[1].relative_change) == (25.0, 0.0, -25.0, -100.0)
    assert (got[7].after_at_risk, got[7].after_rate, got[7].improvement, got[7].relative_change) == (0, None, None, None)
    assert (got[30].before_at_risk, got[30].before_rate) == (3, 33.3)


def test_unlike_plain_retention_young_cohorts_are_not_zero(make_users, make_events):
    users, events = make_users(USERS), make_events([*EVENTS, (5, "2024-02-08 11:00:00", USE)])
    plain = {r.cohort: r for r in retention.cohort_retention(users, events).collect()}
    assert plain["Feb 2024"].day_30_retention == 0.0  # as the original has it
    assert _long(maturity.mature_retention(users, events))["Feb 2024", 30][3] is None


def test_without_events_or_users(make_users, make_events):
    got = _long(maturity.mature_retention(make_users(USERS), make_events([])))
    assert got["Jan 2024", 1] == (4, 0, 0, None)
    assert maturity.mature_retention(make_users([]), make_events(EVENTS)).count() == 0
    assert maturity.mature_retention(make_users([]), make_events([])).count() == 0


def test_repeated_users_count_each_and_repeated_offsets_once(make_users, make_events):
    users = make_users([USERS[0], USERS[0]])
    got = rows(maturity.mature_retention(users, make_events(EVENTS), days=(1, 1, 0)))
    assert got == [("Jan 2024", 0, 2, 2, 0, 0.0), ("Jan 2024", 1, 2, 2, 2, 100.0)]


def test_one_pass_over_events(make_users, make_events, spark):
    """One event scan and one shuffle of activity; in mapping B the orders are the users' table as well."""
    df = QUERIES["mature_retention_month"](spark, SF["0.001"])
    p = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_shipdate", p)) == 1
    assert "Window" not in p
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join FullOuter" in optimized


def test_all_at_risk_users_are_those_signed_up_in_time(spark):
    """Against counts by hand from the tables."""
    got = {(r.cohort, r.day): r for r in QUERIES["mature_retention_month"](spark, SF["0.01"]).collect()}
    users = spark.read.parquet(f"{SF['0.01']}/orders.parquet").groupBy("o_custkey").agg({"o_orderdate": "min"}).collect()
    last = spark.read.parquet(f"{SF['0.01']}/lineitem.parquet").agg({"l_shipdate": "max"}).first()[0].date()
    import datetime as dt

    for day in (1, 30):
        want = sum(1 for _, d in users if d.month == 1 and d.date() + dt.timedelta(days=day) <= last)
        assert got["Jan 2024", day].at_risk == want
