"""Connected components of a graph given as a table of edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysleuth.session import materialized


def connected(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: longs), the root being its component's smallest node, roots too.

    Each round hooks the neighbours of a node to the smallest of them, first the larger ones, then the smaller ones;
    the number of rounds grows with the logarithm of the longest path. Each round is a table in the shared folder.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    now = materialized(now, "edges")
    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_least")).withColumn("_least", F.least("a", "_least"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("_least").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("_least"))
        small = large.join(low, "a").filter("b != _least").select(F.col("b").alias("a"), F.col("_least").alias("b"))
        stars = low.select("a", F.col("_least").alias("b"))
        now = materialized(small.unionByName(stars).distinct(), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
