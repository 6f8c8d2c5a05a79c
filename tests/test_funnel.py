from __future__ import annotations

import pytest
from conftest import rows

from trailmark.operators import funnel

EV = [
    # user 1: full path
    (1, "2024-01-01 00:00:00", "signed_up"),
    (1, "2024-01-01 01:00:00", "created_project"),
    (1, "2024-01-02 00:00:00", "invited_teammate"),
    (1, "2024-01-03 00:00:00", "viewed_pricing_page"),
    (1, "2024-01-03 05:00:00", "upgraded_plan"),
    (1, "2024-01-04 05:00:00", "upgraded_plan"),
    # user 2: project, then pricing without invite (flags are unordered)
    (2, "2024-01-01 00:00:00", "signed_up"),
    (2, "2024-01-01 02:00:00", "created_project"),
    (2, "2023-12-31 02:00:00", "viewed_pricing_page"),
    # user 3: sign-up only
    (3, "2024-01-02 00:00:00", "signed_up"),
    # user 4: sign-up and activity only
    (4, "2024-01-02 00:00:00", "signed_up"),
    (4, "2024-01-03 00:00:00", "used_feature_X"),
    # user 5: upgrade without sign-up or pricing view
    (5, "2024-01-05 00:00:00", "upgraded_plan"),
    # NULL user: forms its own group (SQL GROUP BY)
    (None, "2024-01-05 00:00:00", "signed_up"),
]


def test_user_funnel_flags(make_events):
    got = sorted(rows(funnel.user_funnel_flags(make_events(EV))), key=lambda r: (r[0] is None, r[0] or 0))
    assert got == [
        (1, 1, 1, 1, 1, 1),
        (2, 1, 1, 0, 1, 0),
        (3, 1, 0, 0, 0, 0),
        (4, 1, 0, 0, 0, 0),
        (5, 0, 0, 0, 0, 1),
        (None, 1, 0, 0, 0, 0),
    ]


def test_funnel_steps_counts_and_rates(make_events):
    df = funnel.funnel_steps(make_events(EV))
    assert df.columns == ["funnel_step", "step_number", "user_count", "conversion_rate"]
    got = sorted(rows(df), key=lambda r: r[1])
    assert [r[2] for r in got] == [5, 2, 1, 2, 2]
    # share of sign-ups (5), 1 decimal; step 1 is 100.0
    assert [r[3] for r in got] == [100.0, 40.0, 20.0, 40.0, 40.0]
    assert got[0][0] == "Step 1: Signed Up" and got[4][0] == "Step 5: Upgraded"
    assert dict(df.dtypes) == {
        "funnel_step": "string",
        "step_number": "int",
        "user_count": "bigint",
        "conversion_rate": "double",
    }


def test_funnel_dropoff_is_cumulative_complement(make_events):
    got = sorted(rows(funnel.funnel_dropoff(make_events(EV)), "step_number", "drop_off_rate"))
    assert got == [(1, 60.0), (2, 80.0), (3, 60.0), (4, 60.0), (5, 0.0)]


def test_biggest_dropoff_first_on_ties(make_events):
    got = rows(funnel.funnel_biggest_dropoff(make_events(EV)), "step_number", "drop_off_rate")
    assert got == [(2, 80.0)]
    # all-equal drop-offs: earliest step wins
    names = ("signed_up", "created_project", "invited_teammate", "viewed_pricing_page", "upgraded_plan")
    tie = [(1, "2024-01-01 00:00:00", n) for n in names]
    got = rows(funnel.funnel_biggest_dropoff(make_events(tie)), "step_number")
    assert got == [(1,)]


def test_dropoff_positive(make_events):
    got = sorted(rows(funnel.funnel_dropoff_positive(make_events(EV)), "step_number"))
    assert got == [(1,), (2,), (3,), (4,)]


def test_no_signups_gives_null_rates_and_zero_dropoff(make_events):
    ev = [(1, "2024-01-01 00:00:00", "created_project")]
    got = sorted(rows(funnel.funnel_dropoff(make_events(ev)), "step_number", "user_count", "conversion_rate", "drop_off_rate"))
    assert got[0] == (1, 0, 100.0, 0.0)
    assert got[1] == (2, 1, None, 0.0)


def test_empty_events(make_events):
    got = sorted(rows(funnel.funnel_steps(make_events([])), "step_number", "user_count", "conversion_rate"))
    assert got == [(1, None, 100.0), (2, None, None), (3, None, None), (4, None, None), (5, None, None)]


def test_funnel_kpis(make_events):
    (r,) = funnel.funnel_kpis(make_events(EV)).collect()
    assert (r.signed_up_users, r.activated_users, r.invited_users, r.converted_users) == (5, 2, 1, 2)
    assert (r.activation_rate, r.invite_rate, r.overall_conversion_rate) == (40.0, 20.0, 40.0)


def test_step_over_step(make_events):
    got = sorted(rows(funnel.funnel_step_over_step(make_events(EV)), "step_number", "step_conversion", "step_dropoff"))
    assert got == [(2, 40.0, 60.0), (3, 50.0, 50.0), (4, 200.0, -100.0), (5, 100.0, 0.0)]


def test_share_of_active(make_events):
    (r,) = funnel.funnel_share_of_active(make_events(EV)).collect()
    # 2 users created a project among 6 groups with any event (NULL user included)
    assert r.users_created_project == 2
    assert r.conversion_rate == pytest.approx(33.3)


def test_rounding_half_away_from_zero(make_events):
    # 1 of 8 users -> 12.5 -> 12.5; 1 of 16 -> 6.25 -> 6.3 (half away from zero)
    ev = [(u, "2024-01-01 00:00:00", "signed_up") for u in range(16)] + [(0, "2024-01-01 00:00:00", "created_project")]
    got = dict(rows(funnel.funnel_steps(make_events(ev)), "step_number", "conversion_rate"))
    assert got[2] == 6.3


def test_only_non_step_events_count_zero(make_events):
    ev = [(1, "2024-01-01 00:00:00", "used_feature_X"), (2, "2024-01-02 00:00:00", "used_feature_X")]
    got = sorted(rows(funnel.funnel_steps(make_events(ev)), "step_number", "user_count", "conversion_rate"))
    assert got == [(1, 0, 100.0), (2, 0, None), (3, 0, None), (4, 0, None), (5, 0, None)]


def test_totals_flags_match_full_flags(make_events):
    e = make_events(EV)
    full = funnel._totals_from_flags(funnel.user_funnel_flags(e), funnel.FUNNEL_STEPS)
    cheap = funnel._totals_from_flags(funnel.flags_for_totals(e), funnel.FUNNEL_STEPS)
    assert rows(full) == rows(cheap)
