"""Connected components of an edge table, by rounds that pull vertices towards the least one they know."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Rounds


def _nearer(pairs: DataFrame, all_sides: bool) -> DataFrame:
    """Each vertex's neighbours (all, or the lesser ones) linked with the least of them and of itself."""
    e = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    both = e.union(e.select("v", "u")).toDF("u", "v") if all_sides else e
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    near = both.join(least, F.col("u") == F.col("c"))
    moved = near.filter("v > u").select("v", "m") if all_sides else near.select("v", "m").union(near.select("u", "m"))
    return moved.toDF("u", "v").filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v, of one type, no nulls) -> node, comp: the least node that it reaches.

    Rounds of two joins each (the alternating star steps of Kiveris et al., 2014), about as many
    as the logarithm of the vertices; every round is a written table.
    """
    rounds = Rounds(edges.sparkSession, "components")
    own = rounds.write(edges.select("u", "v"))
    e = rounds.write(own.filter("u <> v").distinct())
    while True:
        e = rounds.write(_nearer(_nearer(e, True), False))
        # Done when all are stars: nobody has two parents, and no parent has one.
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").isEmpty():
            break
    comp = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp"))
    every = own.select(F.col("u").alias("node")).union(own.select("v")).distinct()
    return every.join(comp, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
