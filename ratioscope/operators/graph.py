"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def _settled(e: DataFrame) -> bool:
    """Whether edges (u, v), u above v, are stars already: every u has one v, and no v has a smaller one itself."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    open_ = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
    return open_.isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) of every node with an edge to another node; comp: the smallest node that it reaches.

    ``edges``: long columns a and b.  Nulls and loops are left out, repeats are harmless.  The number of rounds grows with
    the logarithm of the longest path; every round is written to the shared folder, and none is run for edges that are
    stars already.  Minima are combined before the shuffle, and a hot node meets its minimum in a plain join, whose large
    partitions Spark splits.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a != b").distinct()
    e = scratch.write(e, "edges")
    while not _settled(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.write(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        small = scratch.write(small.where("u != v").distinct(), "small")
        scratch.drop(e, large)
        e = small
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
