"""Trees with numbered vertices (tips first), as phylogenetic tools have them, and back."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def to_phylo(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree_id, parent, child, length) and (tree_id, number, label, tip): numbers from 1, tips before inner vertices, each by name."""
    inner = edges.select("tree_id", F.col("from_v").alias("label")).distinct().withColumn("tip", F.lit(False))
    tips = edges.select("tree_id", F.col("to_v").alias("label")).distinct().join(inner.drop("tip"), ["tree_id", "label"], "left_anti").withColumn("tip", F.lit(True))
    order = Window.partitionBy("tree_id").orderBy(F.col("tip").desc(), "label")
    labels = inner.union(tips).select("tree_id", F.row_number().over(order).alias("number"), "label", "tip")
    end = lambda c, n: labels.select("tree_id", F.col("label").alias(c), F.col("number").alias(n))
    numbered = edges.join(end("from_v", "parent"), ["tree_id", "from_v"]).join(end("to_v", "child"), ["tree_id", "to_v"])
    return numbered.select("tree_id", "parent", "child", F.col("weight").alias("length")), labels


def from_phylo(numbered: DataFrame, labels: DataFrame) -> DataFrame:
    """tree_id, from_v, to_v, weight."""
    end = lambda n, c: labels.select("tree_id", F.col("number").alias(n), F.col("label").alias(c))
    return numbered.join(end("parent", "from_v"), ["tree_id", "parent"]).join(end("child", "to_v"), ["tree_id", "child"]).select("tree_id", "from_v", "to_v", F.col("length").alias("weight"))
