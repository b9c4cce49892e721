"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismtab.functions.store import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    sided = both if large else both.filter("v < u")
    least = cut(sided.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m")))
    joined = sided.join(least, F.col("u") == F.col("x"))
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) of every node that an edge (u, v) names and that isn't a root itself. The edges stay distributed; each round is a checkpoint."""
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    state = _state(now)
    while state[0]:
        now = cut(_star(cut(_star(now, True)), False))
        new = _state(now)
        if new == state:
            break
        state = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
