"""Distributed connected components: alternating large-star and small-star rounds.

A round is two aggregates and two joins on node ids, and its edges are written to the
shared checkpoint folder. Stars shrink the depth of every tree by half or so, so the
number of rounds grows with the logarithm of a component's diameter. Edges never reach
the driver; it sees a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, forget, over


def _stars(edges: DataFrame) -> DataFrame:
    """One round. Edges (u, v) have u > v, before and after."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    larger = both.where("v > u").join(least, F.col("u") == F.col("k")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    root = larger.groupBy("u").agg(F.min("v").alias("m"))
    moved = larger.join(root.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(root.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs, in any order and repeated as may be, to (node, root).

    root is the smallest id of the node's component. Nodes without an edge, roots
    themselves and pairs of one node with itself don't appear; nulls are dropped.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    seen = last = None
    while True:
        now = cut_lineage(now)
        if last is not None:
            forget(last)
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if sums == seen or sums["n"] == 0:
            return over(now, now.select(F.col("u").alias("node"), F.col("v").alias("root")))
        seen, last = sums, now
        now = _stars(now)
