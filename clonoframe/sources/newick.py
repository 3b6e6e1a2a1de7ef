"""Newick trees to edges, as a table function over text."""

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse(text: str) -> list[tuple[str, str, float]]:
    """(parent, child, length); inner vertices without a name are called node1, node2, ... in post-order."""
    tokens = re.findall(r"[(),;]|[^(),;]+", text.strip())
    at, made, out = 0, 0, []

    def node():
        nonlocal at, made
        kids = []
        if at < len(tokens) and tokens[at] == "(":
            at += 1
            kids.append(node())
            while tokens[at] == ",":
                at += 1
                kids.append(node())
            if tokens[at] != ")":
                raise ValueError("unbalanced parentheses")
            at += 1
        label = ""
        if at < len(tokens) and tokens[at] not in "(),;":
            label, at = tokens[at], at + 1
        name, _, length = label.partition(":")
        if kids and not name:
            made += 1
            name = f"node{made}"
        out.extend((name, k, n) for k, n in kids)
        return name, float(length or 0)

    node()
    return out


def edges(df: DataFrame, key: str = "tree_id", text: str = "newick") -> DataFrame:
    """key (string), from_v, to_v, weight of all trees; a null or empty tree has none."""

    def run(batches):
        for b in batches:
            rows = [(k, *e) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for e in parse(t)]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols[:3]] + [pa.array(cols[3], pa.float64())], names=[key, "from_v", "to_v", "weight"])

    return df.select(F.col(key).cast("string").alias(key), text).mapInArrow(run, f"{key} string, from_v string, to_v string, weight double")


def is_rooted(edges_: DataFrame) -> DataFrame:
    """tree_id, rooted: whether the root has two children."""
    top = edges_.join(edges_.select("tree_id", F.col("to_v").alias("from_v")), ["tree_id", "from_v"], "left_anti")
    return top.groupBy("tree_id").agg((F.count(F.lit(1)) == 2).alias("rooted"))
