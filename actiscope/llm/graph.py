"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actiscope.session import stored


def _hooked(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Tie neighbours of each node to the least of them and it: its larger ones (large star) or its smaller ones and itself (small star)."""
    near = edges.union(edges.select("b", "a")).toDF("u", "v") if both_ways else edges.toDF("u", "v")
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if both_ways:
        return near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    joined = near.join(least, "u")
    return joined.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that links reach, for every node of ``links`` (a, b).

    Nodes hook onto smaller ones, alternately by large and small stars, until no link changes; the number of
    rounds grows with the logarithm of the longest path. Each round is written to the work folder.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "links")
    mark = None
    while True:
        new = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            break
        mark = new
        edges = stored(_hooked(_hooked(edges, True), False), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
