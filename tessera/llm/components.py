"""Connected components by alternating large-star and small-star steps, all of them joins and sums in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, cut_small

#: A file of a step holds about so many edges, 16 bytes each.
EDGES = 1 << 16


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    linked = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v")))


def stars(edges: DataFrame) -> DataFrame:
    """(u, v): each vertex of (u, v) ``edges`` that isn't the least of its component, with that least one.

    A step is two sums and two joins; the number of steps grows with the logarithm of the
    longest path. Each step's edges are written to the shared folder, so a lost executor costs
    one step at most. Only a count and a checksum come to the driver. No edges: no rows.
    """
    now, seen = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return now
        seen = mark
        now = cut_small(_small(_large(now).distinct()).distinct(), mark[0], EDGES)
