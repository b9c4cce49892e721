"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismtab.llm.common import cut, release

#: Nodes with very many edges are joined apart, by a broadcast of HUBS rows at most; HUB edges at least make one.
HUBS, HUB = 5000, 1000


def _done(edges: DataFrame) -> bool:
    """Is every edge one from a node with no other edge to a root?"""
    if edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        return False
    # Nodes are made distinct where they are, so that a root of very many edges is one row for each task. An inner join, as a
    # semi-join would be moved below that step.
    return not edges.select("v").distinct().join(edges.select(F.col("u").alias("v")).distinct(), "v").limit(1).count()


def _star(edges: DataFrame, n_edges: int, large: bool) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    sided = both if large else both.filter("v < u")
    least = sided.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"), "n")
    hub = max(HUB, 4 * n_edges // HUBS)  # a round has 2 * n_edges at most, so fewer than HUBS nodes have more
    hubs = F.broadcast(least.filter(F.col("n") > hub))
    at = F.col("u") == F.col("x")
    if 4 * n_edges <= hub:
        joined = sided.join(least, at).select("u", "v", "m")
    else:
        joined = sided.join(hubs, at).select("u", "v", "m").union(sided.join(hubs, at, "left_anti").join(least.filter(F.col("n") <= hub), at).select("u", "v", "m"))
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    own = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.union(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node reachable, for every node that an edge (u, v) names and that isn't a root itself.

    The edges stay distributed; each round is written to the shared folder. Loops and repeated edges do no harm.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    n_edges = now.count()
    while not _done(now):
        now = cut(_star(cut(_star(now, n_edges, True)), n_edges, False))
        release(now.sparkSession)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
