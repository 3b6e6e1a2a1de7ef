"""Coverage, abundance and diversity; undefined figures are null, resampling is seeded by (seed, group, block)."""

import math
from statistics import NormalDist
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workspace import Rounds
from .usage import count_clones

#: Clones drawn together in one task, about, and resamplings drawn at once.
PART, BLOCK = 100_000, 20


def _counts(df: DataFrame, group: str, clone: str, copy: str | None = None) -> DataFrame:
    """group, clone, seq_count: sequences or, with copy, the sum of their copies."""
    c = count_clones(df, [group], copy=copy, clone=clone)
    return c.select(group, clone, F.col("copy_count" if copy else "seq_count").alias("seq_count"))


def _chao(n, f1, f2):
    a = F.when(f2 > 0, (n - 1) * f1 / ((n - 1) * f1 + 2 * f2)).otherwise(F.try_divide((n - 1) * (f1 - 1), (n - 1) * (f1 - 1) + 2))
    return 1 - f1 / n * a


def _stats(counts: DataFrame, group: str) -> DataFrame:
    s = counts.groupBy(group).agg(F.sum("seq_count").cast("double").alias("n"), *[F.sum((F.col("seq_count") == k).cast("int")).cast("double").alias(f"f{k}") for k in (1, 2, 3)])
    f0 = F.when(F.col("f2") > 0, (F.col("n") - 1) * F.col("f1") ** 2 / (F.col("n") * 2 * F.col("f2"))).otherwise((F.col("n") - 1) * F.col("f1") * (F.col("f1") - 1) / (F.col("n") * 2))
    return s.withColumns({"coverage": _chao(F.col("n"), F.col("f1"), F.col("f2")), "f0": F.ceil(f0).cast("long")})


def coverage(df: DataFrame, group: str, r: int = 1, clone: str = "clone_id") -> DataFrame:
    """Sample coverage of order r by group; null where the counts of r or r + 1 are missing (order 1: only where empty)."""
    counts = count_clones(df, [group], clone=clone)
    if r == 1:
        return _stats(counts, group).select(group, "coverage")
    x = F.col("seq_count")
    s = counts.groupBy(group).agg(F.sum(x).cast("double").alias("n"), F.sum((x == r).cast("int")).cast("double").alias("a"), F.sum((x == r + 1).cast("int")).cast("double").alias("b"), F.sum(F.when(x >= r, F.pow(x.cast("double"), F.lit(float(r))))).alias("s"))
    part = F.pow((F.col("n") - r) * F.col("a") / ((F.col("n") - r) * F.col("a") + (r + 1) * F.col("b")), F.lit(float(r)))
    return s.select(group, F.when((F.col("a") > 0) & (F.col("b") > 0), 1 - math.factorial(r) * F.col("a") / F.col("s") * part).alias("coverage"))


def complete_abundance(df: DataFrame, group: str, clone: str = "clone_id", copy: str | None = None) -> DataFrame:
    """group, clone_id, p: adjusted shares of the seen clones and shares of the inferred unseen ones (U1, U2, ...)."""
    counts = _counts(df, group, clone, copy)
    s = _stats(counts, group).select(group, "n", "coverage", "f0")
    x = counts.join(s, group).withColumn("q", F.col("seq_count") / F.col("n"))
    lam = (1 - F.col("coverage")) / F.sum(F.col("q") * F.exp(-F.col("seq_count").cast("double"))).over(Window.partitionBy(group))
    seen = x.select(group, F.col(clone).cast("string").alias("clone_id"), (F.col("q") * (1 - lam * F.exp(-F.col("seq_count").cast("double")))).alias("p"))
    unseen = s.filter("f0 > 0").select(group, F.explode(F.sequence(F.lit(1).cast("long"), "f0")).alias("i"), ((1 - F.col("coverage")) / F.col("f0")).alias("p"))
    return seen.union(unseen.select(group, F.concat(F.lit("U"), F.col("i")).alias("clone_id"), "p"))


def hill(shares: DataFrame, group: list[str], qs: list[float], p: str = "p") -> DataFrame:
    """Hill numbers by group and order; the order 1 is taken as 0.9999."""
    q = shares.filter(F.col(p) > 0).withColumn("_t", F.sum(p).over(Window.partitionBy(*group))).withColumn("q", F.explode(F.array(*[F.lit(float(v)) for v in qs])))
    e = F.when(F.abs(F.col("q") - 1) < 1e-9, F.lit(0.9999)).otherwise(F.col("q"))
    out = q.withColumn("_e", e).groupBy(*group, "q", "_e").agg(F.sum(F.pow(F.col(p) / F.col("_t"), F.col("_e"))).alias("s"))
    return out.select(*group, "q", F.pow("s", 1 / (1 - F.col("_e"))).alias("d"))


def _draws(df: DataFrame, group: str, min_n: int, max_n: int | None, uniform: bool, nboot: int, seed: int, clone: str, copy: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Depths, and draws (group, boot, clone_id, p) with a share above 0.

    A group's clones are dealt by hash into parts of about PART; each resampling first draws
    how many go to every part, then the clones within each part, so no task holds a group.
    """
    totals = _counts(df, group, clone, copy).groupBy(group).agg(F.sum("seq_count").alias("n")).filter(F.col("n") >= min_n)
    depth = F.min("n").over(Window.partitionBy(F.lit(1))) if uniform else F.col("n")
    totals = totals.select(group, (F.least(depth, F.lit(max_n)) if max_n else depth).alias("depth"))
    rounds = Rounds(df.sparkSession, "draws")
    shares = rounds.write(complete_abundance(df, group, clone, copy).select(group, "clone_id", F.greatest("p", F.lit(0.0)).alias("p")))
    whole = rounds.write(totals.join(shares.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts")), group))
    shares = shares.join(whole, group).withColumn("part", F.pmod(F.xxhash64("clone_id"), F.col("parts")))
    blocks = F.explode(F.sequence(F.lit(0), F.lit((nboot - 1) // BLOCK))).alias("block")
    sums = shares.groupBy(group, "part").agg(F.sum("p").alias("w"), F.first("depth").alias("depth")).select(group, "part", "w", "depth", blocks)
    size = lambda b: min(BLOCK, nboot - BLOCK * b)
    rng = lambda *key: np.random.default_rng([seed, *key])

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        b, g = int(pdf["block"].iat[0]), str(pdf[group].iat[0])
        x = rng(crc32(g.encode()), b).multinomial(int(pdf["depth"].iat[0]), pdf["w"].to_numpy() / pdf["w"].sum(), size(b))
        return pd.DataFrame({group: g, "part": pdf["part"].to_numpy(), "block": b, "depth": int(pdf["depth"].iat[0]), "n": list(x.T)})

    def draw(pdf: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or of.empty or not pdf["p"].sum():
            return pd.DataFrame({group: [], "boot": [], "clone_id": [], "p": []}).astype({group: object, "boot": "int64", "clone_id": object, "p": float})
        pdf = pdf.sort_values("clone_id")
        b, g, part = int(of["block"].iat[0]), str(of[group].iat[0]), int(of["part"].iat[0])
        p, made = pdf["p"].to_numpy(), rng(crc32(g.encode()), b, part, 1)
        x = np.array([made.multinomial(n, p / p.sum()) for n in of["n"].iat[0]])
        i, c = np.nonzero(x)
        return pd.DataFrame({group: g, "boot": i + BLOCK * b, "clone_id": pdf["clone_id"].to_numpy()[c], "p": x[i, c] / int(of["depth"].iat[0])})

    dealt = sums.groupBy(group, "block").applyInPandas(deal, f"{group} string, part long, block int, depth long, n array<long>")
    each = shares.select(F.col(group).cast("string").alias(group), "part", "clone_id", "p", blocks)
    by = [group, "part", "block"]
    return totals, each.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInPandas(draw, f"{group} string, boot long, clone_id string, p double")


def estimate_abundance(df: DataFrame, group: str, min_n: int = 30, max_n: int | None = None, uniform: bool = True, ci: float = 0.95, nboot: int = 200, seed: int = 0, clone: str = "clone_id", copy: str | None = None) -> DataFrame:
    """group, clone_id, p, p_sd, lower, upper, rank from sparse bootstrap draws (absent draws count as 0); copy: a column of copies that counts instead of rows."""
    z = NormalDist().inv_cdf((1 + ci) / 2)
    _, draws = _draws(df, group, min_n, max_n, uniform, nboot, seed, clone, copy)
    m = draws.groupBy(group, "clone_id").agg((F.sum("p") / nboot).alias("p"), F.sum(F.col("p") * F.col("p")).alias("s"))
    m = m.withColumn("p_sd", F.sqrt(F.greatest(F.lit(0.0), (F.col("s") - nboot * F.col("p") * F.col("p")) / (nboot - 1))))
    m = m.withColumns({"lower": F.greatest(F.lit(0.0), F.col("p") - z * F.col("p_sd")), "upper": F.col("p") + z * F.col("p_sd")})
    return m.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col("p").desc(), "clone_id"))).drop("s")


def alpha_diversity(df: DataFrame, group: str, qs: list[float] | None = None, ci: float = 0.95, nboot: int = 200, seed: int = 0, **how) -> DataFrame:
    """group, q, d, d_sd, d_lower, d_upper, e, e_lower, e_upper over bootstrap draws."""
    qs = sorted({0.0, *(qs if qs is not None else [x / 10 for x in range(41)])})
    z = NormalDist().inv_cdf((1 + ci) / 2)
    _, draws = _draws(df, group, how.get("min_n", 30), how.get("max_n"), how.get("uniform", True), nboot, seed, how.get("clone", "clone_id"), how.get("copy"))
    d = hill(draws, [group, "boot"], qs).groupBy(group, "q").agg(F.avg("d").alias("d"), F.stddev_samp("d").alias("d_sd"))
    d = d.withColumns({"d_lower": F.greatest(F.lit(0.0), F.col("d") - z * F.col("d_sd")), "d_upper": F.col("d") + z * F.col("d_sd")})
    base = F.max(F.when(F.col("q") == 0, F.col("d"))).over(Window.partitionBy(group))
    return d.withColumns({"e": F.col("d") / base, "e_lower": F.col("d_lower") / base, "e_upper": F.col("d_upper") / base})


def diversity_test(df: DataFrame, group: str, q: float, nboot: int = 200, seed: int = 0, **how) -> DataFrame:
    """Two-sided bootstrap test of the difference of each pair of groups."""
    _, draws = _draws(df, group, how.get("min_n", 30), how.get("max_n"), how.get("uniform", True), nboot, seed, how.get("clone", "clone_id"), how.get("copy"))
    d = hill(draws, [group, "boot"], [q])
    pair = d.select("boot", F.col(group).alias("a"), F.col("d").alias("x")).join(d.select("boot", F.col(group).alias("b"), F.col("d").alias("y")), "boot").filter("a < b")
    t = pair.groupBy("a", "b").agg(F.avg(F.col("x") - F.col("y")).alias("m"), F.stddev_samp(F.col("x") - F.col("y")).alias("delta_sd"), F.avg((F.col("x") <= F.col("y")).cast("double")).alias("le"), F.avg((F.col("x") >= F.col("y")).cast("double")).alias("ge"))
    p = F.when(F.col("m") >= 0, F.col("le")).otherwise(F.col("ge"))
    return t.select("a", "b", F.abs("m").alias("delta_mean"), "delta_sd", F.when(p <= 0.5, 2 * p).otherwise(2 * (1 - p)).alias("pvalue"))


#: The former name.
rarefy_diversity = alpha_diversity
