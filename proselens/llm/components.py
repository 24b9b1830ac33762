"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of an edge with the smallest node that it reaches. Each round hooks all neighbours of
    a node to the smallest one; a round's edges are written, so lineage stays short, and only two sums reach the driver."""
    now = materialise(edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        # Large star: a node's larger neighbours go to its smallest neighbour (or itself).
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        first = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(first, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        later = materialise(small, "edges")
        total = later.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(now)
        now = later
        if total == before:
            break
        before = total
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
