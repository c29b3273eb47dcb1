"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component): the smallest node that can be reached.

    Each round re-hangs every node's larger neighbours, then its smaller ones, on the smallest node it
    knows. Minima are taken by grouped aggregation, so a hub with many links is combined before the
    shuffle and its join is left to the skew handling of adaptive execution; no list of neighbours is
    ever built. Rounds grow with the logarithm of the longest chain. Null ends and self links are ignored;
    nodes without a link to another don't appear; no links give an empty table.
    """
    edges = checkpointed(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
        .distinct()
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("low"), F.col("high"))).toDF("node", "other")
        smallest = both.groupBy("node").agg(F.min("other").alias("least"))
        smallest = smallest.select("node", F.least("node", "least").alias("least"))
        large = both.where(F.col("other") > F.col("node")).join(smallest, "node").select(F.col("other").alias("high"), F.col("least").alias("low"))
        large = large.where(F.col("high") != F.col("low")).distinct()
        down = large.groupBy("high").agg(F.min("low").alias("least"))
        moved = large.join(down, "high").where(F.col("low") != F.col("least")).select(F.col("low").alias("high"), F.col("least").alias("low"))
        edges = checkpointed(moved.union(down.select("high", F.col("least").alias("low"))).distinct())
        # the sum of hashes tells whether the set of links still changes
        now = edges.select(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).union(
        edges.select(F.col("low"), F.col("low")).distinct()
    )
