"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is one grouped minimum (combined before the shuffle) and one equi-join; nothing is collected but a row count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """links(a long, b long) to (node, component): the smallest node that can be reached. Nodes without links have no row."""
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    for _ in range(most):
        # Large star: every neighbour that is larger goes to the least of the neighbourhood.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Small star: every smaller neighbour and the node itself go to the least of the smaller ones.
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        last, edges = edges, settle(small, "links")
        discard(last)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
        now = tuple(now.first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = now
    raise RuntimeError(f"components did not settle in {most} rounds")
