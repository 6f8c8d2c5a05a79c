from __future__ import annotations

import pytest
from conftest import D, rows

from trailmark.operators import retention
from trailmark.sources.fixtures import split_cohorts

USERS = [
    (1, D("2024-01-31"), "Free", "A"),
    (2, D("2024-02-01"), "Free", "B"),
    (3, D("2024-03-10"), "Paid", "A"),  # other month -> NULL cohort
    (4, D("2023-01-05"), "Free", "B"),  # January of another year -> "Jan 2024"
    (5, D("2024-01-10"), "Free", "A"),  # no events -> not in the base
]
EVENTS = [
    (1, "2024-01-31 00:00:00", "signed_up"),
    (1, "2024-02-01 10:00:00", "used_feature_X"),  # day 1
    (1, "2024-02-01 23:00:00", "used_feature_X"),  # same day again
    (1, "2024-02-07 08:00:00", "used_feature_X"),  # day 7
    (1, "2024-03-01 23:59:59", "used_feature_X"),  # day 30 across month end (leap year)
    (2, "2024-01-31 12:00:00", "used_feature_X"),  # before sign-up: in the base, no flag
    (2, "2024-02-02 23:59:59", "used_feature_X"),  # day 1 at the last second
    (3, "2024-03-17 00:00:00", "used_feature_X"),  # day 7
    (4, "2023-01-06 00:00:00", "used_feature_X"),  # day 1
    (99, "2024-02-01 00:00:00", "used_feature_X"),  # unknown user
    (None, "2024-02-01 00:00:00", "used_feature_X"),
]


@pytest.fixture
def data(make_users, make_events):
    return make_users(USERS), make_events(EVENTS)


def test_user_cohorts_ignore_year(data):
    users, _ = data
    got = sorted(rows(retention.user_cohorts(users), "user_id", "cohort"))
    assert got == [(1, "Jan 2024"), (2, "Feb 2024"), (3, None), (4, "Jan 2024"), (5, "Jan 2024")]


def test_user_activity_offsets(data):
    got = sorted(rows(retention.user_activity(*data), "user_id", "days_since_signup"))
    assert got == [(1, 1), (1, 1), (1, 7), (1, 30), (2, -1), (2, 1), (3, 7), (4, 1)]


def test_retention_flags(data):
    got = sorted(rows(retention.user_retention_flags(*data)), key=lambda r: r[1])
    assert got == [
        ("Jan 2024", 1, 1, 1, 0, 1),
        ("Feb 2024", 2, 1, 0, 0, 0),
        (None, 3, 0, 1, 0, 0),
        ("Jan 2024", 4, 1, 0, 0, 0),
    ]


def test_cohort_retention_base_and_order(data):
    got = rows(retention.cohort_retention(*data))
    assert got == [
        ("Feb 2024", 1, 100.0, 0.0, 0.0, 0.0),
        ("Jan 2024", 2, 100.0, 50.0, 0.0, 50.0),
        (None, 1, 0.0, 100.0, 0.0, 0.0),
    ]


def test_matrix_and_curve(data):
    m = rows(retention.retention_matrix(*data))
    assert m[1] == ("Jan 2024", 100.0, 50.0, 0.0, 50.0)
    curve = sorted(rows(retention.retention_curve(*data).where("cohort = 'Jan 2024'"), "day", "retention"))
    assert curve == [(1, 100.0), (7, 50.0), (14, 0.0), (30, 50.0)]


def test_improvement_and_comparison(data):
    (imp,) = retention.retention_improvement(*data).collect()
    assert (imp.day_7_improvement, imp.day_1_improvement) == (-50.0, 0.0)
    got = sorted(
        rows(retention.retention_comparison(*data), "day", "before_rate", "after_rate", "improvement", "relative_change")
    )
    assert got == [
        (1, 100.0, 100.0, 0.0, 0.0),
        (7, 50.0, 0.0, -50.0, -100.0),
        (14, 0.0, 0.0, 0.0, None),
        (30, 50.0, 0.0, -50.0, -100.0),
    ]


def test_ratio_doc_counts_events(data):
    got = dict(rows(retention.retention_ratio_doc(*data)))
    assert got == {"Jan 2024": 0.5, "Feb 2024": None, None: 1.0}


def test_split_labeler(data):
    users, events = data
    lab = split_cohorts()
    got = sorted(rows(retention.user_cohorts(users, lab), "user_id", "cohort"))
    assert got == [(1, "after"), (2, "after"), (3, "after"), (4, "before"), (5, "after")]


def test_empty_activity(make_users, make_events):
    got = rows(retention.cohort_retention(make_users(USERS), make_events([])))
    assert got == []


def test_edge_rows(data):
    got = rows(retention.cohort_retention(*data))
    assert got == [
        ("Feb 2024", 1, 100.0, 0.0, 0.0, 0.0),
        ("Jan 2024", 2, 100.0, 50.0, 0.0, 50.0),
        (None, 1, 0.0, 100.0, 0.0, 0.0),
    ]
    assert dict(rows(retention.retention_ratio_doc(*data))) == {
        "Jan 2024": 0.5,
        "Feb 2024": None,
        None: 1.0,
    }


def test_no_limit_on_offsets(data):
    users, events = data
    wide = retention.user_retention_flags(users, events, days=list(range(61)))
    few = retention.user_retention_flags(users, events, days=[1, 30, 31, 60])
    assert wide.columns[-1] == "day_60"
    assert sorted(rows(wide, "cohort", "user_id", "day_1", "day_30", "day_31", "day_60"), key=str) == sorted(rows(few), key=str)


def test_journeys_give_the_same_as_users_and_events(spark):
    from conftest import SF

    from trailmark.sources.fixtures import load_journeys_b, load_mapping_b

    for sf in ("0.001", "0.01"):
        users, events = load_mapping_b(spark, SF[sf])
        journeys = load_journeys_b(spark, SF[sf])
        flags = sorted(map(tuple, retention.journey_flags(journeys).collect()), key=str)
        assert flags == sorted(map(tuple, retention.user_retention_flags(users, events).collect()), key=str)
        for day in (7, 30):
            ratio = sorted(map(tuple, retention.journey_ratio_doc(journeys, day=day).collect()), key=str)
            assert ratio == sorted(map(tuple, retention.retention_ratio_doc(users, events, day=day).collect()), key=str)


def test_journeys_with_nulls(spark):
    rows_in = [
        (1, "2024-01-05", "2024-01-12"), (1, "2024-01-04", None), (1, "2024-01-05", "2024-01-11"), (1, "2024-01-05", "2024-01-11"),
        (2, "2024-01-01", None),  # never active: no base
        (3, None, "2024-01-01"),  # no sign-up: the NULL cohort
        (None, "2024-01-01", "2024-01-02"),
    ]
    df = spark.createDataFrame(rows_in, "user_id long, sign_up_date string, event_timestamp string")
    df = df.selectExpr("user_id", "cast(sign_up_date AS date) AS sign_up_date", "cast(event_timestamp AS timestamp_ntz) AS event_timestamp")
    got = {tuple(r) for r in retention.journey_flags(df).collect()}
    assert got == {("Jan 2024", 1, 0, 1, 0, 0), (None, 3, 0, 0, 0, 0)}
    assert {tuple(r) for r in retention.journey_ratio_doc(df).collect()} == {("Jan 2024", 2.0), (None, None)}
    assert retention.journey_flags(df.limit(0)).collect() == []
