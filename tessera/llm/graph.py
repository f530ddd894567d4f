"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (u, v); comp is the least node of its component.

    Each round points the larger neighbours of a node at its least neighbour, then the smaller ones; the
    number of rounds grows with the logarithm of the size, and each round's edges are at most as many as the last's.
    """
    edges = common.written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v")
        edges = common.written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether every node points at one other, and that at none: then each component is a star around its least node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    node = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return node.where("out > 1 or (out > 0 and into > 0)").agg(F.count(F.lit(1))).first()[0] == 0
