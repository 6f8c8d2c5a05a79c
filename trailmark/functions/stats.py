"""Chi-squared test of independence on a 2x2 table, as column arithmetic.

The test runs on one already-aggregated row, so it is a handful of column
expressions; the p-value uses the JVM's complementary error function
(commons-math3 ships with Spark), so no Python worker is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERF_CLASS = "org.apache.commons.math3.special.Erf"


def erfc_sql(x: str) -> str:
    """Complementary error function of a SQL expression, evaluated in the JVM."""
    return f"CAST(reflect('{ERF_CLASS}', 'erfc', CAST({x} AS DOUBLE)) AS DOUBLE)"


def erfc(x: Column) -> Column:
    """Complementary error function of a column."""
    return F.reflect(F.lit(ERF_CLASS), F.lit("erfc"), x.cast("double")).cast("double")


def normal_quantile_sql(p: str) -> str:
    """The standard normal quantile of a SQL expression between 0 and 1, evaluated in the JVM; NULL for NULL."""
    inverse = f"CAST(reflect('{ERF_CLASS}', 'erfInv', CAST(2 * {p} - 1 AS DOUBLE)) AS DOUBLE)"
    return f"CASE WHEN {p} IS NOT NULL THEN sqrt(2.0D) * {inverse} END"


def normal_cdf_sql(x: str) -> str:
    """The standard normal distribution function of a SQL expression; NULL for NULL."""
    return f"CASE WHEN {x} IS NOT NULL THEN {erfc_sql(f'-({x}) / sqrt(2.0D)')} / 2 END"


def chi2_sf_dof1_sql(stat: str) -> str:
    """Upper tail of the chi-squared distribution with one degree of freedom."""
    return erfc_sql(f"sqrt({stat} / 2.0D)")


def with_chi2_2x2(df: DataFrame, a: str, b: str, c: str, d: str, yates: bool = True) -> DataFrame:
    """Add the test of the 2x2 table [[a, b], [c, d]] (column names) to each row.

    Adds ``chi2``, ``p_value``, ``dof`` and the expected counts
    ``expected_{a,b}_{conv,non}`` (row total * column total / n). With ``yates``
    each cell's |observed - expected| is reduced by min(0.5, itself) (the usual
    continuity correction at one degree of freedom). Everything is NULL when an
    expected count is zero (an empty row or column), where the test is undefined.
    The steps are separate projections for readability; Catalyst collapses them.
    """
    cells = {"a": a, "b": b, "c": c, "d": d}
    t = df.selectExpr(
        "*",
        *[f"CAST({col} AS BIGINT) AS _o_{k}" for k, col in cells.items()],
    ).selectExpr(
        "*",
        "_o_a + _o_b AS _r1",
        "_o_c + _o_d AS _r2",
        "_o_a + _o_c AS _c1",
        "_o_b + _o_d AS _c2",
        "CAST(_o_a + _o_b + _o_c + _o_d AS DOUBLE) AS _n",
    )
    t = t.selectExpr(
        "*",
        "try_divide(CAST(_r1 AS DOUBLE) * _c1, _n) AS _e_a",
        "try_divide(CAST(_r1 AS DOUBLE) * _c2, _n) AS _e_b",
        "try_divide(CAST(_r2 AS DOUBLE) * _c1, _n) AS _e_c",
        "try_divide(CAST(_r2 AS DOUBLE) * _c2, _n) AS _e_d",
    )
    t = t.selectExpr(
        "*",
        "_e_a > 0 AND _e_b > 0 AND _e_c > 0 AND _e_d > 0 AS _valid",
        *[f"abs(CAST(_o_{k} AS DOUBLE) - _e_{k}) AS _dev_{k}" for k in cells],
    )
    if yates:
        terms = [f"try_divide((_dev_{k} - least(0.5D, _dev_{k})) * (_dev_{k} - least(0.5D, _dev_{k})), _e_{k})" for k in cells]
    else:
        terms = [f"try_divide(_dev_{k} * _dev_{k}, _e_{k})" for k in cells]
    t = t.selectExpr("*", f"CASE WHEN _valid THEN {' + '.join(terms)} END AS _stat")
    t = t.selectExpr(
        "*",
        "_stat AS chi2",
        f"CASE WHEN _valid THEN {chi2_sf_dof1_sql('_stat')} END AS p_value",
        "CASE WHEN _valid THEN 1 END AS dof",
        "CASE WHEN _valid THEN _e_a END AS expected_a_conv",
        "CASE WHEN _valid THEN _e_b END AS expected_a_non",
        "CASE WHEN _valid THEN _e_c END AS expected_b_conv",
        "CASE WHEN _valid THEN _e_d END AS expected_b_non",
    )
    return t.drop(*[c for c in t.columns if c.startswith("_")])
