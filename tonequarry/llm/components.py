"""Connected components of a distributed link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonequarry.llm.common import saved


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)`` (longs); the root is the smallest node reachable.

    Each round hooks every node's neighbours to its smallest neighbour, first the larger ones, then the smaller ones;
    the rounds needed grow with the logarithm of the longest chain. A node's links meet only in partial minima and in
    an equi-join, never in one list. Every round is kept in the shared checkpoint folder. Null ends are dropped;
    repeated links and self-links are allowed; an empty table gives no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = saved(edges)
    before = None
    while before != (now := _signature(edges)):
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = saved(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    own = edges.select(F.col("b").alias("a"), "b").distinct()
    return edges.unionByName(own).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
