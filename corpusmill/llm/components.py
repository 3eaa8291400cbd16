"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import deleted, saved


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); root is the smallest node that can be reached.

    Each round is two aggregations and two joins over the edges and is written to the shared folder. Stars keep the
    edge count from growing, and the number of rounds grows with the logarithm of the longest path. Ends when a
    round changes nothing; self-edges and repeated edges are harmless; an empty table gives an empty one.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = now.select("a", "b").union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # each larger neighbour to the least
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        old, now = now, saved(small.where("a <> b").distinct(), "edges")
        deleted(old)
    else:
        raise RuntimeError(f"components: {max_rounds} rounds are not enough")
    roots = now.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
