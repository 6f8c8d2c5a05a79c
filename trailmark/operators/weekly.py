"""Weekly KPIs on a calendar without gaps.

Two kinds of measures meet in one row per week: those of the users who signed up in it (invitation rate,
conversion rate, day-N retention over users observed long enough) and those of the events that fell in it.

Plan shape: both kinds are reduced to a row per week before they meet in a union and one aggregate; weeks
are few (the calendar between the first and the last), so the gaps are filled from one row that holds
them as a map, without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.sqlexpr import lit_sql, pct_sql
from trailmark.operators.maturity import observations
from trailmark.schemas import ACTIVITY_EVENT, INVITED_TEAMMATE, UPGRADED_PLAN
from trailmark.session import materialize as checkpoint_df

COUNTS = ("signups", "invited_users", "converted_users", "at_risk", "retained", "events", "active_users", "invites", "upgrades")


def week_of(date: Column) -> Column:
    """The Monday on or before a date."""
    return F.date_sub(date, F.weekday(date))


def user_days(events: DataFrame, invite_event: str, conversion_event: str, activity_event: str) -> DataFrame:
    """Per (user, date): events, invites, upgrades, and whether there was any activity event."""
    return events.groupBy("user_id", F.to_date("event_timestamp").alias("date")).agg(
        F.count(F.lit(1)).alias("events"),
        F.expr(f"count_if(event_name = {lit_sql(invite_event)}) AS invites"),
        F.expr(f"count_if(event_name = {lit_sql(conversion_event)}) AS upgrades"),
        F.expr(f"coalesce(bool_or(event_name = {lit_sql(activity_event)}), false) AS active"),
    )


def _signup_measures(users: DataFrame, days: DataFrame) -> DataFrame:
    """Per sign-up week: users, and those of them who ever invited or converted."""
    did = days.where(F.col("user_id").isNotNull() & ((F.col("invites") > 0) | (F.col("upgrades") > 0)))
    did = did.groupBy("user_id").agg(F.max("invites").alias("invites"), F.max("upgrades").alias("upgrades"))
    signed = users.where(F.col("sign_up_date").isNotNull()).select(
        "user_id", week_of(F.col("sign_up_date").cast("date")).alias("week")
    )
    return signed.join(did, "user_id", "left").groupBy("week").agg(
        F.count(F.lit(1)).alias("signups"),
        F.expr("count_if(invites > 0) AS invited_users"),
        F.expr("count_if(upgrades > 0) AS converted_users"),
    )


def _event_measures(days: DataFrame) -> DataFrame:
    """Per event week: events, users with any event, invites and upgrades. Users first: no distinct aggregate
    over raw rows."""
    per_user = days.where(F.col("date").isNotNull()).groupBy(week_of(F.col("date")).alias("week"), "user_id")
    per_user = per_user.agg(*[F.sum(c).alias(c) for c in ("events", "invites", "upgrades")])
    return per_user.groupBy("week").agg(
        F.count("user_id").alias("active_users"), *[F.sum(c).alias(c) for c in ("events", "invites", "upgrades")]
    )


def weekly_kpis(
    users: DataFrame,
    events: DataFrame,
    day: int = 7,
    invite_event: str = INVITED_TEAMMATE,
    conversion_event: str = UPGRADED_PLAN,
    activity_event: str = ACTIVITY_EVENT,
    materialize: bool = False,
) -> DataFrame:
    """One row for every week (by its Monday) from the first to the last with a sign-up or an event.

    Of its sign-ups: ``invite_rate`` and ``conversion_rate`` (users who ever did, %, 1 decimal) and
    ``retention`` (active on exactly day ``day``, over those observed that long). Of its events: their number,
    distinct users, invites and upgrades. A week without any has zeros; rates without a base are NULL. All three
    parts start from ``user_days``; with ``materialize`` it is checkpointed, so the events are read once.
    """
    days = user_days(events, invite_event, conversion_event, activity_event)
    if materialize:
        days = checkpoint_df(days)
    dated = days.select(
        "user_id", F.col("date").alias("event_timestamp"), F.when(F.col("active"), F.lit(activity_event)).alias("event_name")
    )
    retained = observations(users, dated, week_of, (day,), activity_event)
    matured = "date_add(sign_up_date, day) <= observed_until"
    retained = retained.groupBy(F.col("cohort").alias("week")).agg(
        F.expr(f"sum(CASE WHEN {matured} THEN users END) AS at_risk"),
        F.expr(f"sum(CASE WHEN {matured} THEN active END) AS retained"),
    )
    parts = [_signup_measures(users, days), retained, _event_measures(days)]
    together = parts[0]
    for p in parts[1:]:
        together = together.unionByName(p, allowMissingColumns=True)
    # one row: as many entries as the calendar has weeks
    by_week = together.groupBy("week").agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in COUNTS])
    calendar = by_week.agg(
        F.min("week").alias("first"),
        F.max("week").alias("last"),
        F.map_from_entries(F.collect_list(F.struct("week", F.struct(*COUNTS).alias("v")))).alias("weeks"),
    )
    filled = calendar.where("first IS NOT NULL").selectExpr("weeks", "explode(sequence(first, last, INTERVAL 7 DAY)) AS week")
    filled = filled.selectExpr("week", *[f"coalesce(try_element_at(weeks, week).{c}, 0L) AS {c}" for c in COUNTS])
    return filled.selectExpr(
        "week",
        "signups",
        "invited_users",
        f"{pct_sql('invited_users', 'signups', 1)} AS invite_rate",
        "converted_users",
        f"{pct_sql('converted_users', 'signups', 1)} AS conversion_rate",
        "at_risk",
        "retained",
        f"{pct_sql('retained', 'at_risk', 1)} AS retention",
        "events",
        "active_users",
        "invites",
        "upgrades",
    ).orderBy("week")
