"""Connected components of an edge table by alternating large-star and small-star steps, on joins and groupings only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _state(edges: DataFrame):
    """Number and order-free digest of the edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of any order and multiplicity -> (node, comp), comp the smallest node reachable; nodes without an
    edge to another node are absent. Each round is stored; rounds grow with the logarithm of the longest path."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _state(now)
    while True:
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # large-star also keeps a node's link to its own minimum
        large = large.unionAll(least.where("a <> m").select("a", F.col("m").alias("b"))).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = _state(now)
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionAll(
                now.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()
        seen = state
