"""CSV records checked one by one: typed rows, and the rejected lines with the reasons.

Files are read as lines, so the raw record is at hand whatever is wrong with it. Each line is parsed with the
columns of the header; a line is rejected if it is blank, has too few or too many fields, or holds text
that is no value of its column's type (empty text is NULL and fine). Every line but the headers is either
valid or rejected. Nothing is shuffled and nothing is read twice: ``checked_lines`` is one narrow plan, of
which ``valid_rows`` and ``rejected_rows`` are filters.

A header is a line that holds exactly the column names; every file may have its own. One in another order
than the first file's is an error, as its file's fields would be taken for others. Quoted fields may hold
separators, but no line breaks: such a record is two lines, each rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BAD = "_record"
_QUOTED = '"[^"]*"'


def header_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names by the header of the first file."""
    return [c.lstrip("﻿") for c in spark.read.option("header", True).csv(path).columns]


def _reasons(schema: T.StructType, columns: list[str]) -> Column:
    width = F.size(F.split(F.regexp_replace("line", _QUOTED, ""), ","))
    wrong_width = F.concat(width.cast("string"), F.lit(f" fields instead of {len(columns)}"))
    # a blank line is NULLs for the parser; a wrong width is the one fault it keeps the record for
    first = (
        F.when(F.trim("line") == "", F.lit("blank line"))
        .when(F.col(f"fields.{_BAD}").isNotNull(), F.when(width != len(columns), wrong_width).otherwise(F.lit("unreadable record")))
    )
    wrong = [first]
    for field in schema.fields:
        kind = field.dataType.simpleString()
        if kind != "string":
            text = F.col(f"fields.{field.name}")
            bad = first.isNull() & text.isNotNull() & text.try_cast(field.dataType).isNull()
            wrong.append(F.when(bad, F.concat(F.lit(f"{field.name} is no {kind}: "), text)))
    return F.array_compact(F.array(*wrong))


def checked_lines(lines: DataFrame, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """``lines`` (a column ``line``; others are kept) with the typed columns of ``schema`` and ``reasons``, an
    array that is empty for a valid line. ``columns`` is the order of the fields (default: the schema's).
    Headers are dropped."""
    columns = list(columns or [f.name for f in schema.fields])
    missing = [f.name for f in schema.fields if f.name not in columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}; the header is {', '.join(columns)}")
    record = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, _BAD]])
    plain = F.regexp_replace("line", "^﻿", "")
    parsed = lines.withColumn("line", plain).withColumn(
        "fields", F.from_csv("line", F.lit(record.toDDL()), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    )
    names = F.array(*[F.lit(c) for c in columns])
    fields = F.array(*[F.col(f"fields.`{c}`") for c in columns])
    is_header = F.array_sort(fields) == F.array_sort(names)
    other_order = F.raise_error(F.concat(F.lit("columns in another order than the first file's: "), F.col("line")))
    body = parsed.where(~F.when(is_header & (fields != names), other_order.cast("boolean")).otherwise(is_header))
    typed = [F.col(f"fields.`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields]
    return body.select(*lines.columns, *typed, _reasons(schema, columns).alias("reasons"))


def read_checked(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``checked_lines`` of a CSV file or folder, with ``file``."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return checked_lines(lines, schema, header_columns(spark, path))


def valid_rows(checked: DataFrame, schema: T.StructType) -> DataFrame:
    return checked.where(F.size("reasons") == 0).select(*[f.name for f in schema.fields])


def rejected_rows(checked: DataFrame) -> DataFrame:
    """``line`` (and ``file``), and what is wrong with it, joined with semicolons."""
    where = [c for c in ("file",) if c in checked.columns]
    return checked.where(F.size("reasons") > 0).select(*where, "line", F.concat_ws("; ", "reasons").alias("reason"))


def quarantine(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(typed valid rows, rejected lines) of a CSV file or folder."""
    checked = read_checked(spark, path, schema)
    return valid_rows(checked, schema), rejected_rows(checked)


def strict_rows(checked: DataFrame, schema: T.StructType) -> DataFrame:
    """All rows, or an error that names the first rejected line met. Also when only rows are counted."""
    wrong = F.raise_error(F.concat(F.concat_ws("; ", "reasons"), F.lit(" in line: "), F.col("line")))
    sound = F.when(F.size("reasons") > 0, wrong.cast("boolean")).otherwise(F.lit(True))
    return checked.where(sound).select(*[f.name for f in schema.fields])


def rejections(checked: DataFrame) -> DataFrame:
    """Lines by kind of fault (``valid`` among them; the first fault counts, without the value). The sum
    is the number of lines."""
    kind = F.coalesce(F.regexp_replace(F.try_element_at("reasons", F.lit(1)), ": .*", ""), F.lit("valid"))
    return checked.groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).alias("n_lines"))
