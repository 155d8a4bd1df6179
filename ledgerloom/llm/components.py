"""Connected components of links, by alternating large and small stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import save


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b); root is the least node that can be reached.

    Each round hangs every node's larger neighbours, then its smaller ones, onto the least of them;
    when nothing changes, every node hangs onto its root. Rounds grow with the logarithm of the longest
    path. A node with many links is split by the engine's skew handling, minima are taken before
    the shuffle.
    """
    edges = save(links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_least_neighbour(both), "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        large = save(large)
        least = _least_neighbour(large)
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v")))
                 .where("u <> v").distinct())
        small = save(small)
        # hung onto their roots: every node has one edge, and roots have none to smaller nodes
        deep = small.join(small.select(F.col("u").alias("v")), "v", "left_semi")
        twice = small.groupBy("u").count().where("count > 1")
        edges = small
        if deep.isEmpty() and twice.isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
