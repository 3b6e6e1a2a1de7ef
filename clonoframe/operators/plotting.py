"""What the plots show, as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import topology

#: Bins of the histograms.
BINS = 50


def abundance_series(abundance: DataFrame, group: str) -> DataFrame:
    """group, rank, p, lower, upper of an estimated abundance."""
    return abundance.select(group, "rank", "p", "lower", "upper")


def diversity_series(diversity: DataFrame, group: str, score: str = "diversity") -> DataFrame:
    """group, q, y, lower, upper: the curve of diversity or of evenness."""
    if score not in ("diversity", "evenness"):
        raise ValueError("score must be diversity or evenness")
    c = score[0]
    return diversity.select(group, "q", F.col(c).alias("y"), F.col(f"{c}_lower").alias("lower"), F.col(f"{c}_upper").alias("upper"))


def diversity_at(diversity: DataFrame, group: str, q: float) -> DataFrame:
    """group, d, lower, upper: the mean and one standard deviation to each side at one order."""
    return diversity.filter(F.abs(F.col("q") - q) < 1e-9).select(group, "d", (F.col("d") - F.col("d_sd")).alias("lower"), (F.col("d") + F.col("d_sd")).alias("upper"))


def histogram(df: DataFrame, value: str, bins: int = BINS) -> DataFrame:
    """bin, low, high, count: bins of one width from the least to the largest value (half to each side if they are one); empty ones too."""
    v = F.col(value).cast("double")
    lo, hi = df.agg(F.min(v), F.max(v)).first()
    empty = df.sparkSession.range(0 if lo is None else bins).select(F.col("id").alias("bin"))
    lo, hi = (lo - 0.5, hi + 0.5) if lo == hi and lo is not None else (lo or 0.0, hi or 0.0)
    width = (hi - lo) / bins or 1.0
    n = df.filter(v.isNotNull()).groupBy(F.least(F.floor((v - lo) / width), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return empty.join(n, "bin", "left").select("bin", (F.lit(lo) + F.col("bin") * width).alias("low"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """value, ecdf: the share of rows up to each value (values are counted first, so the window is over different ones)."""
    n = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    all_ = n.agg(F.sum("_n").alias("_all"))
    upto = F.sum("_n").over(Window.orderBy(value))
    return n.crossJoin(F.broadcast(all_)).select(value, (upto / F.col("_all")).alias("ecdf"))  # one row: the total


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, least, q1, q2, q3, most of a value."""
    at = lambda q, name: F.percentile(value, F.lit(q)).alias(name)
    return df.filter(F.col(value).isNotNull()).groupBy(group).agg(F.count(value).alias("n"), F.min(value).alias("least"), at(0.25, "q1"), at(0.5, "q2"), at(0.75, "q3"), F.max(value).alias("most"))


def subtree_boxes(edges: DataFrame, labels: DataFrame, stat: str, exclude=("Germline", None)) -> DataFrame:
    """value, n, least, q1, q2, q3, most: a subtree figure over its tree's largest (or sum), by annotation."""
    if stat not in ("outdegree", "size", "depth", "pathlength"):
        raise ValueError("stat must be outdegree, size, depth or pathlength")
    s = topology.subtrees(edges).select("tree_id", F.col("name").alias("v"), F.col(f"{stat}_norm").alias("y"))
    return box_stats(s.join(labels, ["tree_id", "v"], "left").filter(~topology.excluded(F.col("value"), exclude)), "value", "y")


def tree_layout(edges: DataFrame, root: str = "Germline") -> DataFrame:
    """tree_id, name, x, y: leaves side by side in the order of a walk, parents above the middle of their children, y the steps below the root."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        kids: dict[str, list[str]] = {}
        for a, b in sorted(zip(pdf["from_v"], pdf["to_v"], strict=True)):
            kids.setdefault(a, []).append(b)
        top = root if root in kids else next(v for v in sorted(kids) if v not in set(pdf["to_v"]))
        depth, order, todo = {top: 0}, [], [top]
        while todo:
            v = todo.pop()
            order.append(v)
            for k in reversed(kids.get(v, [])):
                if k not in depth:
                    depth[k] = depth[v] + 1
                    todo.append(k)
        x: dict[str, float] = {}
        for v in order:
            if v not in kids:
                x[v] = float(len(x))
        for v in reversed(order):
            if v in kids:
                x[v] = sum(x[k] for k in kids[v]) / len(kids[v])
        return pd.DataFrame({"tree_id": pdf["tree_id"].iat[0], "name": order, "x": [x[v] for v in order], "y": [-depth[v] for v in order]})

    kind = edges.schema["tree_id"].dataType.simpleString()
    return edges.select("tree_id", "from_v", "to_v").groupBy("tree_id").applyInPandas(one, f"tree_id {kind}, name string, x double, y long")
