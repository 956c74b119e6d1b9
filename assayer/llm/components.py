"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.staging import join_hot, scratch, staged


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node that it reaches.

    Each round is grouped minima and two equi-joins; an edge count and checksum end it. Nodes with one in 1,024 of all
    edges or more are joined by broadcast, so that the root of a giant component burdens no task. Rounds are written
    to the shared folder, so a lost executor costs a reread. Loops, nulls and repeated edges are dropped.
    """
    now = staged(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "edges"
    )
    before = None
    n = now.count()
    for _ in range(max_rounds):
        with scratch():
            both = now.union(now.select("v", "u"))
            least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
            hung = join_hot(both.filter("v > u"), least, "u", "n", 2 * n)
            large = staged(hung.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
            least = staged(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
            hung = join_hot(large, least, "u", "n", n)
            small = hung.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            now = staged(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges", outlive=True)
        n, check = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, check) == before:
            break
        before = (n, check)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select("v", "v").distinct()
    )
