"""No caps, no stale sources, no silent losses."""

from __future__ import annotations

import shutil

import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from trailmark.functions.stats import with_chi2_2x2
from trailmark.operators import funnel, kpis
from trailmark.plans.registry import QUERIES
from trailmark.sources.csv import read_events, read_users, write_csv


def test_new_files_are_seen_by_the_same_query(spark, tmp_path):
    (tmp_path / "events.parquet").mkdir()
    shutil.copy(f"{SF['0.001']}/customer.parquet", tmp_path)
    shutil.copy(f"{SF['0.001']}/events.parquet", tmp_path / "events.parquet/a.parquet")
    (before,) = QUERIES["kpi_totals"](spark, str(tmp_path)).collect()
    shutil.copy(f"{SF['0.001']}/events.parquet", tmp_path / "events.parquet/b.parquet")
    (after,) = QUERIES["kpi_totals"](spark, str(tmp_path)).collect()
    assert after.total_events == 2 * before.total_events


def test_every_event_row_counts(spark):
    total = spark.read.parquet(f"{SF['0.01']}/events.parquet").count()
    assert QUERIES["kpi_totals"](spark, SF["0.01"]).first().total_events == total
    assert QUERIES["dataset_summary"](spark, SF["0.01"]).first().total_events == total
    assert QUERIES["event_distribution"](spark, SF["0.01"]).agg(F.sum("event_count")).first()[0] == total


def test_forty_funnel_steps(make_events):
    steps = [(i + 1, f"step {i}", f"s{i}", f"e{i}") for i in range(40)]
    events = make_events([(u, "2024-01-01 00:00:00", f"e{i}") for u in (1, 2) for i in range(40) if u == 1 or i % 2])
    flags = {r.user_id: [r[f"s{i}"] for i in range(40)] for r in funnel.user_funnel_flags(events, steps).collect()}
    assert flags == {1: [1] * 40, 2: [i % 2 for i in range(40)]}


def test_chi_squared_of_ten_billion_users(spark):
    df = spark.createDataFrame([(2_000_000_000, 3_000_000_000, 2_500_000_000, 2_500_000_000)], "a long, b long, c long, d long")
    (r,) = with_chi2_2x2(df, "a", "b", "c", "d").collect()
    assert r.chi2 > 1e6 and r.p_value == 0.0


def test_event_names_are_not_gathered_in_one_task(spark, make_events):
    events = spark.range(20_000).selectExpr(
        "id AS event_id", "id AS user_id", "timestamp_ntz'2024-01-01 00:00:00' AS event_timestamp", "concat('n', id) AS event_name"
    )
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for op in (kpis.event_distribution, kpis.event_types):
            assert op(events).rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def _csv(tmp_path, text):
    path = tmp_path / "in.csv"
    path.write_text(text)
    return str(path)


def test_csv_columns_go_by_name(spark, tmp_path):
    path = _csv(tmp_path, "user_id,plan_type,sign_up_date,ab_test_group\n1,Paid,2024-01-05,A\n")
    (r,) = read_users(spark, path).collect()
    assert (r.user_id, str(r.sign_up_date), r.plan_type, r.ab_test_group) == (1, "2024-01-05", "Paid", "A")
    with pytest.raises(ValueError, match="ab_test_group"):
        read_users(spark, _csv(tmp_path, "user_id,plan_type,sign_up_date\n1,Paid,2024-01-05\n"))


def test_csv_timestamp_forms_and_bad_values(spark, tmp_path):
    head = "event_id,user_id,event_timestamp,event_name\n"
    path = _csv(tmp_path, head + "1,1,2024-01-05T10:00:00,a\n2,1,2024-01-05 10:00,b\n3,,2024-01-05 10:00:00.5,c\n")
    assert [str(r.event_timestamp)[:16] for r in read_events(spark, path).orderBy("event_id").collect()] == ["2024-01-05 10:00"] * 3
    for row in ("1,x7,2024-01-05 10:00:00,a", "1,7,soon,a"):
        with pytest.raises(Exception, match="is no"):
            read_events(spark, _csv(tmp_path, head + row + "\n")).collect()


def test_written_tables_are_not_overwritten_by_default(spark, tmp_path):
    df = spark.range(3)
    write_csv(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="already exists"):
        write_csv(df, str(tmp_path / "out"))


def test_sql_over_users_and_events(spark):
    """Tables and SQL text are plain Spark: register the frames, write the query."""
    from trailmark.sources.fixtures import load_mapping_a

    users, events = load_mapping_a(spark, SF["0.001"])
    users.createOrReplaceTempView("users")
    events.createOrReplaceTempView("events")
    got = spark.sql("SELECT count(DISTINCT e.user_id) FROM events e JOIN users u USING (user_id)").first()[0]
    assert rows(users.agg(F.count("*"))) == [(got,)]
