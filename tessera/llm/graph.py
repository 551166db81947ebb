"""Connected components of a link table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import forget, stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node of edges(a, b).

    Alternating large-star and small-star steps: every step joins each node's neighbours to the
    smallest one, so no task holds more than sums, and the number of steps grows with the
    logarithm of the longest path. Each step's table is written to the shared folder, and
    the tables before it are deleted. Loops and repeated edges are harmless; null ends are dropped.
    """
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", clean=False)
    state = None
    for _ in range(rounds):
        # Large star: neighbours above a node move to its smallest neighbour.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(now.join(low.select(F.col("u").alias("v"), "m"), "v").select("u", F.col("m").alias("v")))
        large = large.where("u != v").distinct()
        # Small star: a node and its smaller neighbours move to the smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(low.select("u", F.col("m").alias("v")))
        after = stored(small.distinct(), "edges", clean=False)
        sums = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        forget(now)
        now = after
        if (sums.n, sums.h) == state:
            break
        state = (sums.n, sums.h)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
