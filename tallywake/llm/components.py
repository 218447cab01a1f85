"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywake.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest one."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", "m")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node of ``links`` (columns a, b) that is not a root itself.

    Links may repeat, in either direction; a link of a node to itself says
    nothing, and one with a null is left out. No group is ever gathered: a node's
    neighbours meet only in a minimum. The steps end when all edges lead to roots,
    which takes about the square of the logarithm of the longest chain.
    """
    edges = cut_lineage(links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    while True:
        edges = cut_lineage(_small_star(_large_star(edges)))
        # Done when every edge leads to a root: then no end of an edge is the start of another.
        if edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
