"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, merged


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, v) -> (u, m): the lowest of u and its neighbours; partial minima before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both)
    return both.filter("v > u").join(merged(low), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(merged(low), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) longs -> (node, low): every linked node but the lowest of its component, and that lowest node.

    Each round is cut from its lineage. Stops when every node has one link and none leads to a node that has one: then
    all go straight to the lowest.
    """
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        now = cut(_small_star(_large_star(now)))
        n, nodes = now.agg(F.count("*"), F.countDistinct("u")).first()
        if n == nodes and now.join(merged(now.select(F.col("u").alias("node"))), F.col("v") == F.col("node"), "left_semi").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("low"))
