"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release

LARGEST_ROUNDS = 60


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): joins each with the least of u and its v (the sums combine before the shuffle)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("_u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges (u, v long, no nulls) -> node, comp (the least node that it reaches), for every node with an edge.

    Each round is two distributed joins over a written edge table; only whether it was the last
    reaches the driver. Stars around a hub stay linear: a hub's rows are split by the
    adaptive join.
    """
    e = scratch.write(edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).filter("u <> v").distinct(), f"{name}-0")
    for i in range(1, LARGEST_ROUNDS):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        s = _star(large)
        small = s.select(F.col("v").alias("u"), F.col("m").alias("v")).union(s.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = scratch.write(small, f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        del both, large, s, small
        # Done when every node has one parent at most, and no parent has one.
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty():
            break
        release(scratch.spark)
    # The edges are now stars around each component's least node.
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
