"""Text times in several forms, with a report of what was read how.

Each form is a pattern and the way from its groups to an ISO time, so a value is read by the forms that it
has and by no guess; dates that no calendar has are not read. A value that two forms read differently
(``03/04/2024``, day or month first) is refused. Results carry no time zone; those given with an offset are
in UTC. Nothing depends on the session's time zone.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DATE = r"(\d{4}-\d{2}-\d{2})"
_CLOCK = r"(\d{2}:\d{2}(?::\d{2})?)"
_NUMBERS = r"(\d{1,2})[/.](\d{1,2})[/.](\d{4})"


class Form(NamedTuple):
    name: str
    pattern: str
    iso: str  # the groups as an ISO time; with an offset, the time before it


FORMS = (
    Form("date", rf"^{_DATE}$", "$1"),
    Form("space", rf"^{_DATE} {_CLOCK}$", "$1 $2"),
    Form("T", rf"^{_DATE}T{_CLOCK}$", "$1 $2"),
    Form("fraction", rf"^{_DATE}[ T](\d{{2}}:\d{{2}}:\d{{2}}\.\d{{1,6}})\d{{0,3}}$", "$1 $2"),
    Form("offset", rf"^{_DATE}[ T](\d{{2}}:\d{{2}}(?::\d{{2}}(?:\.\d{{1,6}})?)?) ?(Z|[+-]\d{{2}}:?\d{{2}})$", "$1 $2"),
    Form("day_first", rf"^{_NUMBERS}(?: {_CLOCK})?$", "$3-$2-$1 $4"),
    Form("month_first", rf"^{_NUMBERS}(?: {_CLOCK})?$", "$3-$1-$2 $4"),
)
AMBIGUOUS, UNREAD = "ambiguous", "unread"


def _reading(text: Column, form: Form) -> Column:
    iso = F.when(text.rlike(form.pattern), F.regexp_replace(text, form.pattern, form.iso))
    read = F.trim(iso).try_cast("timestamp_ntz")
    if form.name != "offset":
        return read
    offset = F.regexp_extract(text, form.pattern, 3)
    digits = F.regexp_replace(offset, "[^0-9]", "")
    minutes = F.coalesce(F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    east = F.when(offset.startswith("-"), -minutes).otherwise(minutes)
    return F.timestamp_add("MINUTE", -east, read)


def read_times(df: DataFrame, column: str, forms: Sequence[Form] = FORMS) -> DataFrame:
    """``df`` with the text ``column`` as a time without zone, and ``<column>_form``: the form it was read by,
    ``ambiguous`` or ``unread`` (the time is NULL then), NULL for a NULL or blank text."""
    text = F.trim(F.col(column).cast("string"))
    readings = F.array(*[F.struct(F.lit(f.name).alias("form"), _reading(text, f).alias("at")) for f in forms])
    found = df.withColumn("_readings", F.filter(readings, lambda r: r["at"].isNotNull()))
    times = F.array_distinct(F.transform("_readings", lambda r: r["at"]))
    form = (
        F.when(text.isNull() | (text == ""), F.lit(None).cast("string"))
        .when(F.size(times) > 1, F.lit(AMBIGUOUS))
        .when(F.size(times) == 0, F.lit(UNREAD))
        .otherwise(F.try_element_at("_readings", F.lit(1))["form"])
    )
    at = F.when(F.size(times) == 1, F.try_element_at("_readings", F.lit(1))["at"])
    return found.withColumns({f"{column}_form": form, column: at}).drop("_readings")


def time_forms(read: DataFrame, column: str) -> DataFrame:
    """Rows by form of a frame from ``read_times``, with the first and last time read so."""
    return read.groupBy(F.col(f"{column}_form").alias("form")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(column).alias("first_time"), F.max(column).alias("last_time")
    )
