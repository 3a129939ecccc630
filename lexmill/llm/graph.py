"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import dropped, staged


def _unfinished(edges: DataFrame) -> int:
    """1 if some node has two parents, or one while it is a parent; 0 for stars."""
    nodes = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    roles = nodes.groupBy("node").agg(F.sum("up").alias("parents"), F.min("up").alias("least"))
    return roles.where("parents > 1 or (parents = 1 and least = 0)").limit(1).count()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node and root (the smallest node of its component) of every node of an edge table, roots included.

    Each round first links every node's larger neighbours to its smallest one, then its smaller neighbours, which halves
    paths; a logarithmic number of rounds leaves stars. The smallest neighbour is a partial aggregate. One number a round
    goes to the driver.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    now = staged(edges.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct(), "edges")
    while _unfinished(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, staged(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(last)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
