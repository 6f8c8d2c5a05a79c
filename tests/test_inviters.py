"""Inviters against others (X3) and sample sizes."""

from __future__ import annotations

import math

import pytest
from conftest import SF, D, rows

from trailmark.functions.stats import normal_cdf_sql, normal_quantile_sql
from trailmark.operators import inviters, power
from trailmark.plans.registry import QUERIES

INV, UP, PROJ = "invited_teammate", "upgraded_plan", "created_project"


def _at(hour):
    return f"2024-01-01 {hour:02d}:00:00"


EVENTS = [
    (1, _at(1), INV), (1, _at(2), UP),  # converts after the invite
    (2, _at(3), UP), (2, _at(4), INV),  # before it
    (3, _at(5), INV), (3, _at(5), UP),  # at the same time: not after
    (4, _at(6), INV), (4, _at(7), PROJ),  # never
    (5, _at(1), UP), (5, _at(2), UP), (5, _at(3), PROJ),  # no invite, converts once
    (6, _at(1), "signed_up"),
    (7, _at(1), UP), (7, _at(2), INV), (7, _at(3), UP),  # a later upgrade is not the first
    (8, _at(9), UP), (8, _at(2), INV), (8, _at(4), INV), (8, _at(3), UP),  # rows in any order
    (None, _at(1), INV), (None, _at(2), UP),
    (9, None, INV), (9, _at(2), UP),  # an invite without a time is none
]


def test_only_first_upgrades_after_the_first_invite_convert(make_events):
    got = rows(inviters.conversion_by_invite(make_events(EVENTS)))
    assert got == [("invited", 6, 2, 3, 33.33), ("not_invited", 3, 2, 0, 66.67)]


def test_restricted_to_users_of_another_step(make_events):
    got = rows(inviters.conversion_by_invite(make_events(EVENTS), base_event=PROJ))
    assert got == [("invited", 1, 0, 0, 0.0), ("not_invited", 1, 1, 0, 100.0)]


def test_risk_ratio_and_interval(make_events):
    (r,) = inviters.invite_risk_ratio(make_events(EVENTS)).collect()
    ratio, se = (2 / 6) / (2 / 3), math.sqrt(1 / 2 - 1 / 6 + 1 / 2 - 1 / 3)
    assert (r.inviters, r.others, r.risk_ratio, r.difference_pp) == (6, 3, 0.5, -33.3333)
    assert (r.ratio_low, r.ratio_high) == (round(ratio * math.exp(-1.959964 * se), 4), round(ratio * math.exp(1.959964 * se), 4))
    assert r.significant is False


def test_interval_excludes_one_for_a_clear_difference(make_events):
    ev = [(u, _at(1), INV) for u in range(200)] + [(u, _at(2), UP) for u in range(100)]
    ev += [(u, _at(1), "signed_up") for u in range(1000, 1200)] + [(u, _at(2), UP) for u in range(1000, 1020)]
    (r,) = inviters.invite_risk_ratio(make_events(ev)).collect()
    assert r.risk_ratio == 5.0 and r.ratio_low > 1 and r.significant is True


@pytest.mark.parametrize(
    "events, want",
    [
        ([], (0, 0, None, None, None)),
        ([(1, _at(1), INV)], (1, 0, None, None, None)),
        ([(1, _at(1), INV), (2, _at(1), PROJ)], (1, 1, None, None, None)),  # nobody converts
        ([(1, _at(1), INV), (2, _at(1), UP)], (1, 1, 0.0, None, None)),  # only others do
    ],
)
def test_undefined_ratios_are_null(make_events, events, want):
    (r,) = inviters.invite_risk_ratio(make_events(events)).collect()
    assert (r.inviters, r.others, r.risk_ratio, r.ratio_low, r.ratio_high) == want
    assert [x[0] for x in rows(inviters.conversion_by_invite(make_events(events)))] == ["invited", "not_invited"]


def test_one_scan_without_window(spark):
    p = QUERIES["invite_risk_ratio"](spark, SF["0.001"])._jdf.queryExecution().executedPlan().toString()
    assert p.count("FileScan") == 1 and "Window" not in p and "Join" not in p and "partial_min" in p


def _summary(spark, a, b):
    data = [(g, n, c, None if rate is None else float(rate)) for g, (n, c, rate) in (("A", a), ("B", b)) if n is not None]
    return spark.createDataFrame(data, "ab_test_group string, total_users long, conversions long, conversion_rate double")


def test_published_sample_sizes(spark):
    plan = power.power_plan_from_summary(_summary(spark, (169, 32, 18.93), (184, 41, 22.28)))
    got = {r.difference: r for r in plan.collect()}
    assert got["4 points"].per_arm == 1620 and got["3 points"].per_arm == 2832
    spread = 0.1893 * 0.8107 + 0.2228 * 0.7772  # from the 2-decimal rates, as the lift
    assert got["observed"].per_arm == math.ceil((1.959963985 + 0.841621234) ** 2 * spread / 0.0335**2) == 2285
    assert got["4 points"].total == 3240 and got["4 points"].smaller_arm_now == 169 and got["4 points"].enough_now is False
    assert 0.05 < got["observed"].power_now < 0.2


def test_power_at_the_needed_size_is_the_wanted_power(spark):
    plan = power.power_plan_from_summary(_summary(spark, (1620, 0, 18.93), (1620, 0, 22.93)), differences=(4.0,), power=0.8)
    (r,) = plan.where("difference = '4 points'").collect()
    assert r.enough_now is True and abs(r.power_now - 0.8) < 0.001
    more = power.power_plan_from_summary(_summary(spark, (10, 0, 18.93), (10, 0, 18.93)), (4.0,), power=0.9, alpha=0.01).collect()
    assert more[1].per_arm == math.ceil((2.5758293 + 1.2815516) ** 2 * (0.1893 * 0.8107 + 0.2293 * 0.7707) / 0.04**2)


def test_zero_difference_missing_group_and_impossible_targets_are_null(spark):
    same = power.power_plan_from_summary(_summary(spark, (100, 10, 10.0), (100, 10, 10.0)), differences=(-20.0, 95.0)).collect()
    assert [(r.per_arm, r.total, r.enough_now, r.power_now) for r in same] == [(None,) * 4] * 3
    alone = power.power_plan_from_summary(_summary(spark, (100, 10, 10.0), (None, 0, 0))).collect()
    assert alone[0].per_arm is None and alone[1].per_arm > 0 and alone[1].power_now is None
    assert all(r.per_arm is None for r in power.power_plan_from_summary(_summary(spark, (None, 0, 0), (None, 0, 0))).collect())


def test_normal_quantile_and_distribution(spark):
    ps = [0.001, 0.025, 0.2, 0.5, 0.8, 0.975, 0.999]
    df = spark.createDataFrame([(p,) for p in ps] + [(None,)], "p double")
    got = df.selectExpr("p", f"{normal_quantile_sql('p')} AS z").selectExpr("p", "z", f"{normal_cdf_sql('z')} AS back").collect()
    known = {0.025: -1.959963984540054, 0.2: -0.8416212335729143, 0.5: 0.0, 0.975: 1.959963984540054}
    for r in got[:-1]:
        assert abs(r.back - r.p) < 1e-12 and abs(r.z - known.get(r.p, r.z)) < 1e-12
