"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a minimum per node and a join, so no node's neighbours are gathered. A node with very
many links is pre-aggregated before the shuffle, and the join's large side can be split by adaptive
execution. Every round is a written table: it survives lost executors and cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.sources.scratch import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node with a link; the component is its smallest node.

    Repeated links, links in both directions and links of a node to itself are allowed. NULL ends
    make no link. No links: an empty table.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = written(edges, "links")
    # Done once every smaller end is the root of a star: no link leads on from it.
    while not edges.isEmpty() and not edges.select("v").join(
            edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() or _forks(edges):
        edges = written(_small_star(_large_star(edges)), "star")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
        edges.select("v", "v").distinct())


def _forks(edges: DataFrame) -> bool:
    """Whether a node is linked to two smaller ones."""
    return not edges.groupBy("u").agg(F.min("v").alias("x"), F.max("v").alias("y")).where(
        "x != y").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node among all of them."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    smaller = edges.join(least, "u").where("v != m").select(
        F.col("v").alias("u"), F.col("m").alias("v"))
    return smaller.union(least).distinct()
