"""Weekly KPIs on a calendar without gaps."""

from __future__ import annotations

from conftest import SF, D

from trailmark.operators import weekly
from trailmark.plans.registry import QUERIES

INV, UP, USE = "invited_teammate", "upgraded_plan", "used_feature_X"
USERS = [
    (1, D("2024-01-01"), "Free", "A"),  # a Monday
    (2, D("2024-01-07"), "Free", "A"),  # the Sunday of that week
    (3, D("2024-01-22"), "Free", "B"),
    (4, None, "Free", "B"),
]
EVENTS = [
    (1, "2024-01-01 00:00:00", INV),
    (1, "2024-01-08 10:00:00", USE),  # day 7
    (2, "2024-01-24 10:00:00", UP),
    (2, "2024-01-24 11:00:00", UP),
    (9, "2024-01-24 11:00:00", INV),  # of no user
    (None, "2024-01-25 11:00:00", "x"),
    (3, None, INV),  # no time: in no week, but user 3 invited
]


def test_weeks_line_up_and_empty_ones_appear(make_users, make_events):
    got = {str(r.week): r for r in weekly.weekly_kpis(make_users(USERS), make_events(EVENTS)).collect()}
    assert list(got) == ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22"]
    first, second, empty, last = got.values()
    assert (first.signups, first.invited_users, first.invite_rate, first.converted_users, first.conversion_rate) == (2, 1, 50.0, 1, 50.0)
    assert (first.at_risk, first.retained, first.retention) == (2, 1, 50.0)
    assert (first.events, first.active_users, first.invites, first.upgrades) == (1, 1, 1, 0)
    assert (second.signups, second.events, second.active_users, second.invite_rate, second.retention) == (0, 1, 1, None, None)
    assert tuple(empty)[1:] == (0, 0, None, 0, None, 0, 0, None, 0, 0, 0, 0)
    assert (last.signups, last.invited_users, last.at_risk, last.retention) == (1, 1, 0, None)  # too young for day 7
    assert (last.events, last.active_users, last.invites, last.upgrades) == (4, 2, 1, 2)  # no id: an event, no user


def test_sign_ups_alone_and_nothing(make_users, make_events):
    got = weekly.weekly_kpis(make_users(USERS), make_events([])).collect()
    assert [(str(r.week), r.signups, r.events, r.retention) for r in got] == [
        ("2024-01-01", 2, 0, None), ("2024-01-08", 0, 0, None), ("2024-01-15", 0, 0, None), ("2024-01-22", 1, 0, None),
    ]
    assert weekly.weekly_kpis(make_users([]), make_events([])).collect() == []


def test_spine_is_bounded_by_the_data(spark):
    for name in ("weekly_kpis", "weekly_kpis_orders"):
        got = QUERIES[name](spark, SF["0.01"]).collect()
        weeks = [r.week for r in got]
        assert all((b - a).days == 7 for a, b in zip(weeks, weeks[1:])) and weeks[0].weekday() == 0
        assert got[0].signups + got[0].events > 0 and got[-1].signups + got[-1].events > 0


def test_sums_are_those_of_the_tables(spark):
    got = QUERIES["weekly_kpis"](spark, SF["0.01"]).collect()
    totals = QUERIES["kpi_totals"](spark, SF["0.01"]).first()
    assert sum(r.events for r in got) == totals.total_events and sum(r.upgrades for r in got) == totals.conversion_events
    assert sum(r.signups for r in got) == totals.total_users


def test_checkpointed_days_give_the_same(make_users, make_events):
    users, events = make_users(USERS), make_events(EVENTS)
    assert weekly.weekly_kpis(users, events, materialize=True).collect() == weekly.weekly_kpis(users, events).collect()
