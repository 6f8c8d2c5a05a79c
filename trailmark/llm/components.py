"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round replaces the links by stars around smaller ids, so hubs spread over many rows and the
number of rounds grows with the logarithm of the longest path. Rounds are cut by tables in the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links: u, v (long). Returns node, component (the least id reachable) for each linked node
    that is not itself the least of its component."""
    links = stored(links.where("u <> v").distinct(), "links")
    before = None
    while True:
        links = stored(_small_star(_large_star(links)), "stars")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before or not now[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = tuple(now)
