from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trailmark.schemas import EVENTS, USERS  # noqa: E402
from trailmark.session import build_session  # noqa: E402

SF = {k: f"/root/testdata/sf{k}" for k in ("0.001", "0.01", "0.1")}


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[8]", app_name="trailmark-tests", shuffle_partitions=8)
    yield s
    s.stop()


def D(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def TS(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


@pytest.fixture
def make_users(spark):
    def make(rows):
        return spark.createDataFrame(rows, USERS)

    return make


@pytest.fixture
def make_events(spark):
    def make(rows):
        return spark.createDataFrame(
            [(i + 1, u, TS(t) if isinstance(t, str) else t, n) for i, (u, t, n) in enumerate(rows)], EVENTS
        )

    return make


def rows(df, *cols):
    """Collect as a list of tuples (selected columns, in the frame's order)."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
