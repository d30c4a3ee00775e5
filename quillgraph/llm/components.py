"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is two shuffles of the edges; a node's neighbours are only reduced (minimum) and
joined, never gathered, so a hub is no hot task beyond what map-side combining leaves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges(u, v) with u > v. Each node's neighbours are tied to the least node."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """edges(a, b) -> node, root: root is the least node reachable. Nodes without edges are absent.

    Self loops and nulls are ignored; each round is written to the shared folder, so a lost
    executor costs one round. Raises if ``max_rounds`` is not enough, never returns half a result.
    """
    u, v = F.col(a), F.col(b)
    now = stored(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        now = stored(_star(_star(now, True), False), "edges")
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if (row[0], row[1]) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = (row[0], row[1])
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
