"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import checkpointed


def are_stars(links: DataFrame) -> bool:
    """Whether every ``hi`` of links (hi, lo) has one ``lo``, and no ``lo`` is a ``hi``."""
    ends = links.select(F.col("hi").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(links.select(F.col("lo").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down > 0 and up > 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of undirected edges (u, v); the component is its smallest node.

    Each round joins every node's neighbours to the smallest of them, first those above it, then those
    below; lineage is cut in the shared checkpoint folder.  It ends when all links are stars: every node
    has one link down at most, and none where a link comes down to it.
    """
    down = edges.select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct()
    loops = down.where("hi = lo").select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    links = checkpointed(down.where("hi <> lo"))
    while not are_stars(links):
        around = links.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(links.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = around.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))
        above = around.join(least, "n").where("m > n").select(F.col("m").alias("hi"), F.col("least").alias("lo")).distinct()
        lowest = above.groupBy("hi").agg(F.min("lo").alias("least"))
        below = above.join(lowest, "hi").where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        links = checkpointed(below.unionByName(lowest.select("hi", F.col("least").alias("lo"))).distinct())
    named = links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return named.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
