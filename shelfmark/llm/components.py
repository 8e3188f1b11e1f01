"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and a join back to the links, so no
neighbour list is ever gathered. A node that holds a large share of the links is only one side of
a plain inner join, which adaptive skew handling splits. Links are staged after each round: a lost
executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.session import stage


def _lowest(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the node's smallest neighbour."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return (both.join(_lowest(both), "a").filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("low").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, are linked with the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = _lowest(down)
    moved = (down.join(low, "a").filter(F.col("b") != F.col("low"))
             .select(F.col("b").alias("a"), F.col("low").alias("b")))
    return moved.union(low.select("a", F.col("low").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``a``, ``b`` (bigint) to ``id``, ``component`` (its smallest reachable id), linked ids only.

    Links of a node with itself are ignored; no links give no rows.
    """
    now = stage(links.filter(F.col("a") != F.col("b")).distinct(), "links")
    mark = None
    while True:
        now = stage(_small_star(_large_star(now)).filter(F.col("a") != F.col("b")).distinct(),
                    "links")
        seen = now.agg(F.count(F.lit(1)).alias("n"),
                       F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark:
            break
        mark = seen
    members = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return members.union(members.select(F.col("component").alias("id"), "component").distinct())
