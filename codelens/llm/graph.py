"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, component)``, the component being its smallest node.

    Only nodes with an edge appear.  Each round hangs the larger neighbours of a node, then the smaller
    ones, under the smallest known; rounds end when the edges stop changing.  A node's minimum comes from
    an aggregation that combines before its shuffle, and is joined back, so that a node with very many
    neighbours is a skewed join, which Spark splits, and never one task's group.
    """
    own = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(own, "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = materialise(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = new
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
