"""Connected components of an undirected graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.llm.common import settled


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # settled, here and below: both sides of the join are then shuffled for it alone, and Spark can split a hub's part
    least = settled(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = settled(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (columns u, v, both long): root is the smallest node reachable.

    Each round is a few joins and groupings on nodes, so a hub's links are combined before they are shuffled and
    no group is gathered. Only the number of edges and a checksum come to the driver. Loops (u = v) are kept as
    nodes of their own; null ends are dropped; an empty table gives an empty result.
    """
    nodes = settled(edges.where("u is not null and v is not null").select("u", "v"))  # read twice below
    alone = nodes.select("u").union(nodes.select("v"))
    now, before = settled(nodes.where("u <> v").distinct()), None
    for _ in range(rounds):
        stars = settled(_large_star(now).where("u <> v").distinct())  # read twice
        now = settled(_small_star(stars).where("u <> v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    own = alone.select(F.col("u").alias("node")).distinct().join(roots.select("node"), "node", "left_anti")
    return roots.union(own.select("node", F.col("node").alias("root")))
