"""Connected components of an edge table by alternating large and small stars.

Every round replaces edges by stars around smaller neighbours; a round is two
aggregations and joins over the edges, written to shared storage, and the number
of rounds grows with the logarithm of the longest path. Nothing but a row count
and a checksum reaches the driver; minima are aggregated before the shuffle, so a
star around one node is no hot spot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(
        F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs -> (u, component): the smallest node reachable, for every node but it."""
    e = (edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
         .distinct())
    e, state = written(e, "edges"), None
    while state != (state := _state(e)):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").distinct())
        large = written(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v != m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .where("u != v").distinct(), "edges")
    return e.groupBy("u").agg(F.min("v").alias("component"))
