"""Column and DataFrame helpers: SQL-expression shapes, statistics, small-result shaping (all JVM-side)."""

from trailmark.functions.frames import side_by_side, sort_few
from trailmark.functions.sqlexpr import bitmask_agg, lit_sql, pct_sql, ratio_sql, stack_rows, unpack_bits
from trailmark.functions.stats import erfc, with_chi2_2x2

__all__ = [
    "bitmask_agg",
    "erfc",
    "lit_sql",
    "pct_sql",
    "ratio_sql",
    "side_by_side",
    "sort_few",
    "stack_rows",
    "unpack_bits",
    "with_chi2_2x2",
]
