"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidestream.shared import cut


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the least of the node's neighbourhood."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))  # so that a hub's links can be split
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every neighbour not larger than a node, and the node, are linked to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    inner = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return inner.union(least.select("a", F.col("m").alias("b")))


def _state(links: DataFrame) -> tuple:
    """Equal for equal sets of links: count, and two sums over hashes of the links."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``links(a, b)``; ``component`` is the least node reachable.

    Links may repeat, point either way, or join a node to itself; no links give no rows. Only row counts and hash sums reach the
    driver. Each round is checkpointed, so a lost executor costs one round.
    """
    links = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while before != (now := _state(links)):
        before = now
        links = cut(_small_star(_large_star(links).distinct()).distinct())
    leaves = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(leaves.select(F.col("component").alias("node"), "component").distinct())
