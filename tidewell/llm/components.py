"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours. Cut, so that a join on u can split a hub's rows."""
    return checkpointed(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).collect()[0])


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) of every node of the edges (columns a, b) but the roots; ``root`` is the least node of its component.

    Each round links every node's larger neighbours to its least one, then its smaller ones, which
    keeps components whole and ends in stars after a number of rounds about the logarithm of the
    longest path. Loops and repeated edges do not matter. Only counts reach the driver.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = checkpointed(now)
    before = _state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least_neighbour(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpointed(large.filter("u <> v").distinct())
        least = _least_neighbour(large)
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
