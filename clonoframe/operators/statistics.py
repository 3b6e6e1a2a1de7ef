"""Column checks and combined p-values."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

_N = NormalDist()


@arrow_udf(T.DoubleType())
def normal_quantile(p: pa.Array) -> pa.Array:
    """The standard normal's quantile; infinite at 0 and 1."""
    ends = {0.0: -math.inf, 1.0: math.inf}
    return pa.array([None if x is None else ends[x] if x in ends else _N.inv_cdf(x) for x in p.to_pylist()], pa.float64())


@arrow_udf(T.DoubleType())
def normal_upper(z: pa.Array) -> pa.Array:
    """The standard normal's upper tail."""
    x = z.to_numpy(zero_copy_only=False)
    return pa.array([math.erfc(v / math.sqrt(2)) / 2 for v in np.nan_to_num(x, nan=0.0)], pa.float64(), mask=~z.is_valid().to_numpy(zero_copy_only=False))


def stouffer(df: DataFrame, group: list[str], p: str = "p", w: str | None = None) -> DataFrame:
    """group, z, pvalue: the p-values of each group combined by Stouffer's method, weighted by w (equally without); null p-values don't count."""
    weight: Column = F.col(w).cast("double") if w else F.lit(1.0)
    x = df.filter(F.col(p).isNotNull()).select(*group, normal_quantile(1 - F.col(p).cast("double")).alias("_x"), weight.alias("_w"))
    z = x.groupBy(*group).agg(F.try_divide(F.sum(F.col("_w") * F.col("_x")), F.sqrt(F.sum(F.col("_w") * F.col("_w")))).alias("z"))
    return z.withColumn("pvalue", normal_upper(F.col("z")))


def check_columns(df: DataFrame, columns: list[str], logic: str = "all") -> bool | str:
    """True, or what is wrong: columns that are missing, or (by one job) without any value."""
    if logic not in ("all", "any"):
        raise ValueError("logic must be all or any")
    columns = [c for c in columns if c is not None]
    found = [c for c in columns if c in df.columns]
    if logic == "all" and len(found) < len(columns):
        return f"The column {next(c for c in columns if c not in found)} was not found"
    if not found:
        return "Input must contain at least one of the columns: " + ", ".join(columns) if columns else True
    some = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(found)]).first()
    empty = [c for i, c in enumerate(found) if not some[i]]
    if logic == "all" and empty:
        return f"The column {empty[0]} contains no data"
    if logic == "any" and len(empty) == len(found):
        return "None of the columns " + ", ".join(found) + " contain data"
    return True
