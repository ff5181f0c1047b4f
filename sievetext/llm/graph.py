"""Connected components of an edge table, by alternating star steps.

Every step is a partial aggregate and a join on the node, so one node with very
many neighbours is combined on the map side and split by the adaptive skew
join; each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on ``(a, b)`` with a > b: every node's (larger / smaller)
    neighbours move to the least node of its neighbourhood."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(least, "a")
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            joined.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``(a, b)`` edges whose
    root (the least node reachable) is another node.

    Null ends, loops and repeated edges change nothing; no edges give no rows.
    Large-star and small-star steps alternate until the edges stay the same
    (O(log² n) rounds); their count and a hash sum tell.
    """
    ends = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(ends, "edges")
    before = None
    for _ in range(max_rounds):
        seen = now.agg(F.count("*").alias("n"),
                       F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("h")).first()
        if seen["n"] == 0 or (seen["n"], seen["h"]) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = (seen["n"], seen["h"])
        now = materialize(_star(_star(now, large=True), large=False), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
