"""Connected components of a table of links, by large-star and small-star steps.

Every step hangs the neighbours of a node on the smallest of them, first the
larger neighbours, then the smaller; the link table never grows, and after
O(log n) rounds it is a star per component.  Minima are aggregated before the
shuffle, so a hub with very many links is one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrisk.llm.shared import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links``: distinct (a, b) with a > b."""
    if large:  # both directions; every larger neighbour of u goes to the minimum around u
        around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = around.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # the minimum itself keeps u
        own = least.where(F.col("m") < F.col("a")).select("a", F.col("m").alias("b"))
        moved = moved.unionByName(own)
    else:      # smaller neighbours of u and u itself go to the smallest
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (smallest node reachable) of every node with a link."""
    edges = cut(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                .where(F.col("a") != F.col("b")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        edges = cut(_star(_star(edges, True), False))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
