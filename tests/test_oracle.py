"""Every registered query against its DuckDB oracle on the small driver tables."""

from __future__ import annotations

import os

import pytest
from conftest import SF

from __spark_entry__ import entry
from trailmark.plans.oracle import ORACLE_SQL
from trailmark.plans.registry import QUERIES
from tools.oracle_check import digest, duck

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF["0.001"])


def test_every_query_has_an_oracle():
    assert set(ORACLE_SQL) == set(QUERIES)


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns == ["funnel_step", "step_number", "user_count", "conversion_rate", "drop_off_rate"]
    assert df.count() == 5


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF["0.001"])
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE_SQL[name])
    d_cols, d_rows = [c[0] for c in res.description], res.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert digest(s_cols, s_rows)[0] == digest(d_cols, d_rows)[0]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle_sf001(spark, name):
    con = duck(SF["0.01"])
    df = QUERIES[name](spark, SF["0.01"])
    res = con.execute(ORACLE_SQL[name])
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(
        [c[0] for c in res.description], res.fetchall()
    )[0]


SPARK_TO_DUCK = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def test_result_types_match_oracle(spark, con):
    for name, q in QUERIES.items():
        df = q(spark, SF["0.001"])
        rel = con.sql(ORACLE_SQL[name])
        spark_types = {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes}
        duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        assert spark_types == duck_types, name


def test_date_results_do_not_depend_on_session_time_zone(spark):
    names = ["daily_events_by_type", "cohort_retention", "user_activity", "daily_signups", "cohort_retention_month"]
    q = QUERIES
    before = {n: sorted(map(tuple, q[n](spark, SF["0.001"]).collect()), key=str) for n in names}
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        after = {n: sorted(map(tuple, q[n](spark, SF["0.001"]).collect()), key=str) for n in names}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert before == after
