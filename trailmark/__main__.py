"""Run the analysis on a users table and an event log.

    python -m trailmark --users data/users.csv --events data/events.csv --out results/
    spark-submit --py-files trailmark.zip trailmark/__main__.py --format parquet
        --users s3://.../users/ --events s3://.../events/ --out s3://.../out/   (one line)

Writes one headered CSV folder per result under ``--out`` (the funnel with
drop-off, the A/B summary, test and lift, cohort retention and its comparison,
and the one-row summary). Without ``--out`` the (small) results are printed.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from trailmark.plans.report import analysis_tables
from trailmark.schemas import BASELINE_COHORT, COMPARISON_COHORT
from trailmark.session import build_session
from trailmark.sources.csv import read_events, read_users, write_csv
from trailmark.operators.retention import date_split_cohorts


def analysis(
    users: DataFrame,
    events: DataFrame,
    split: dt.date | None = None,
    materialize: bool = True,
) -> dict[str, DataFrame]:
    """The report's result tables. Cohorts are sign-up months, or before / after ``split``."""
    if split is not None:
        labeler, baseline, comparison = date_split_cohorts(split), "before", "after"
    else:
        labeler, baseline, comparison = None, BASELINE_COHORT, COMPARISON_COHORT
    return analysis_tables(users, events, labeler, baseline, comparison, materialize=materialize)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m trailmark", description=__doc__.splitlines()[0])
    parser.add_argument("--users", required=True, help="users table (folder or file)")
    parser.add_argument("--events", required=True, help="events table (folder or file)")
    parser.add_argument("--format", default="csv", help="input format: csv (headered) or any Spark source, e.g. parquet")
    parser.add_argument("--out", help="output folder; one CSV folder per result")
    parser.add_argument("--split", type=dt.date.fromisoformat, help="compare sign-ups before / after this date")
    args = parser.parse_args(argv)

    spark = spark or build_session()
    users = read_users(spark, args.users, fmt=args.format)
    events = read_events(spark, args.events, fmt=args.format)
    for name, df in analysis(users, events, args.split).items():
        if args.out:
            write_csv(df, f"{args.out.rstrip('/')}/{name}")
        else:
            print(f"\n== {name}")
            df.show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
