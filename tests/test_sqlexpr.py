from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trailmark.functions.sqlexpr import bitmask_agg, lit_sql, stack_rows, unpack_bits


@pytest.mark.parametrize(
    "value",
    ["plain", "it's", "back\\slash", 'dou"ble', "Step 1: Signed Up", 7, -3, 2.5, 100.0, True, dt.date(2024, 2, 29), None],
)
def test_literals_round_trip(spark, value):
    got = spark.range(1).select(F.expr(lit_sql(value)).alias("v")).first().v
    assert got == value


def test_bitmask_and_unpack(spark):
    df = spark.createDataFrame(
        [(1, "a"), (1, "c"), (2, "b"), (2, None), (3, "z")], "user_id long, name string"
    )
    masks = df.groupBy("user_id").agg(bitmask_agg("name", ["a", "b", "c"], "m"))
    flags = masks.selectExpr("user_id", *unpack_bits("m", ["fa", "fb", "fc"]))
    got = sorted(tuple(r) for r in flags.collect())
    assert got == [(1, 1, 0, 1), (2, 0, 1, 0), (3, 0, 0, 0)]
    assert dict(flags.dtypes)["fa"] == "int"


def test_bitmask_of_many_values(spark):
    masks = spark.range(0, 70, 3).withColumnRenamed("id", "x").agg(bitmask_agg("x", list(range(70)), "m"))
    (row,) = masks.selectExpr(*unpack_bits("m", [f"f{i}" for i in range(70)])).collect()
    assert list(row) == [int(i % 3 == 0) for i in range(70)]


def test_stack_rows(spark):
    wide = spark.createDataFrame([(10, 20)], "a long, b long")
    got = stack_rows(wide, [[lit_sql("first"), "a"], [lit_sql("second"), "b"]], ["label", "value"]).collect()
    assert [tuple(r) for r in got] == [("first", 10), ("second", 20)]
