"""SQL-expression forms of the recurring column shapes.

Each Column-API call is a JVM round trip from Python (``F.col`` alone is ~20 in
PySpark 4), so wide, mechanical expressions (five flags, a 5x5 unpivot) cost
thousands of round trips to *build*. The same expressions as one SQL string are
parsed in the JVM in a single call; the resulting plan is identical.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


MASK_BITS = 31  # flags in one INT


def lit_sql(value) -> str:
    """A Python value as a SQL literal (strings quoted, doubles typed as DOUBLE)."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def bitmask_agg(column: str, values, alias: str) -> Column:
    """``bit_or`` of bit i for rows where ``column = values[i]``: which values ever occurred, as one INT.

    Combines map-side like ``max``; through a shuffle it is one field instead of
    one per value (each field is an 8-byte slot). More than 31 values become an array of
    such masks, read by ``unpack_bits`` in the same way.
    """
    values = list(values)
    masks = []
    for at in range(0, max(len(values), 1), MASK_BITS):
        part = values[at : at + MASK_BITS]
        bits = " | ".join(f"CASE WHEN `{column}` = {lit_sql(v)} THEN {1 << i} ELSE 0 END" for i, v in enumerate(part))
        masks.append(f"bit_or({bits or 0})")
    return F.expr(masks[0] if len(masks) == 1 else f"array({', '.join(masks)})").alias(alias)


def unpack_bits(mask: str, names) -> list[str]:
    """0/1 INT columns ``names[i]`` from bit i of ``mask`` (SQL select expressions)."""
    names = list(names)
    word = (lambda i: mask) if len(names) <= MASK_BITS else (lambda i: f"{mask}[{i // MASK_BITS}]")
    return [f"shiftright({word(i)}, {i % MASK_BITS}) & 1 AS {name}" for i, name in enumerate(names)]


def pct_sql(part: str, whole: str, digits: int | None = None) -> str:
    """``100 * part / whole`` as a DOUBLE, NULL when ``whole`` is 0 (optionally rounded half-up)."""
    value = f"100.0D * {part} / nullif({whole}, 0)"
    return f"round({value}, {digits})" if digits is not None else value


def ratio_sql(part: str, whole: str) -> str:
    """``part / whole * 100`` in that operation order, NULL when ``whole`` is 0."""
    return f"try_divide(CAST({part} AS DOUBLE), {whole}) * 100.0D"


def stack_rows(df: DataFrame, rows: list[list[str]], names: list[str]) -> DataFrame:
    """Unpivot (each row of) ``df`` into ``len(rows)`` rows with SQL ``stack``.

    ``rows[i][j]`` is the SQL expression of column ``names[j]`` in output row ``i``;
    expressions in one position must share a type.
    """
    body = ",\n  ".join(", ".join(row) for row in rows)
    return df.selectExpr(f"stack({len(rows)},\n  {body}) AS ({', '.join(names)})")
