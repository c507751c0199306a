"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixatlas.llm.stored import stored


def _least(edges: DataFrame) -> DataFrame:
    """For each ``u`` the least of itself and its ``v``."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for all nodes of edges (u, v).

    Minima are taken before rows meet, so a node with very many edges costs its tasks no
    more memory; each round is written to the shared folder, and the rounds grow with the logarithm
    of the longest path.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(edges, "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above a node are tied to its least neighbour.
        large = both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "large-star")
        # Small star: a node and its neighbours below are tied to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = stored(small, "small-star")
        changed = small.join(edges, ["u", "v"], "left_anti").limit(1).count() or edges.join(small, ["u", "v"], "left_anti").limit(1).count()
        edges = small
        if not changed:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
