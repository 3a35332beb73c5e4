"""Connected components of a graph that is spread over the cluster: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u is linked to the least of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its neighbours below u are linked to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v), of any orderable type, u <> v -> (u, v): each node but the least of its component, with the least one.

    A group's minimum is combined before the shuffle and joined back, so no task gathers the neighbours of a node, and
    Spark splits the join at nodes with very many links. Each round is written to the shared folder.
    """
    edges = cut(edges.where("u <> v").distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    before = mark(edges)
    while before[0]:
        edges = cut(_small_star(_large_star(edges)))
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges
