"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round is two aggregations with map-side combining and a join; nothing but a checksum comes to
the driver, and every round's links are a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _checksum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links (u, v): node, component (its smallest node), for every node that has a link. Loops and repeated links do no harm; without links there are no rows."""
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    links = materialise(links, "links")
    before = None
    while (now := _checksum(links)) != before and now[0]:
        before = now
        # large star: every larger neighbour of u is linked with the least of u and its neighbours
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        least = materialise(least, "least")  # read afresh, so that the join can split a hub's rows
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of u and u itself are linked with the least of them
        large = materialise(large, "large")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        links = materialise(small.filter("u <> v").distinct(), "links")
    roots = links.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
