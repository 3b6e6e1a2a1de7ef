"""Set-level sequence operators: masks and padding by group, pairwise distances, duplicates with ambiguous characters."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequences import AA_CHARS, DNA_CHARS, aa_distance, dna_distance, seq_dist, seq_equal


def mask_ends(df: DataFrame, seq: str, group: list[str], mask: str = "N", max_mask: int | None = None, trim: bool = False, out: str = "masked") -> DataFrame:
    """Masks (or trims) as many places at each end as the longest masked end in the group, at most max_mask."""
    w = Window.partitionBy(*group)
    run = lambda p: F.max(F.char_length(F.regexp_extract(seq, p, 0))).over(w)
    cap = lambda c: F.least(c, F.lit(max_mask)) if max_mask is not None else c
    df = df.withColumns({"_l": cap(run(f"^{mask}*")), "_r": cap(run(f"{mask}*$"))})
    core = F.substring(F.col(seq), F.col("_l") + 1, F.greatest(F.char_length(seq) - F.col("_l") - F.col("_r"), F.lit(0)))
    made = core if trim else F.concat(F.repeat(F.lit(mask), F.col("_l")), core, F.repeat(F.lit(mask), F.col("_r")))
    return df.withColumn(out, made).drop("_l", "_r")


def pad_ends(df: DataFrame, seq: str, group: list[str], length: int = 0, start: bool = False, pad: str = "N", mod3: bool = True, out: str = "padded") -> DataFrame:
    width = F.greatest(F.max(F.char_length(seq)).over(Window.partitionBy(*group)), F.lit(length))
    width = (F.ceil(width / 3) * 3).cast("int") if mod3 else width
    df = df.withColumn("_w", width)
    fill = F.repeat(F.lit(pad), F.col("_w") - F.char_length(seq))
    return df.withColumn(out, F.concat(fill, F.col(seq)) if start else F.concat(F.col(seq), fill)).drop("_w")


def pairs(df: DataFrame, key: str, seq: str, group: list[str]) -> DataFrame:
    """Unordered pairs of a group with sequences of equal length, an equi-join on (group, length)."""
    x = df.withColumn("_n", F.char_length(seq))
    a = x.select(*group, "_n", F.col(key).alias("id_i"), F.col(seq).alias("seq_i"))
    b = x.select(*group, "_n", F.col(key).alias("id_j"), F.col(seq).alias("seq_j"))
    return a.join(b, [*group, "_n"]).filter("id_i < id_j").drop("_n")


def pairwise_dist(df: DataFrame, key: str, seq: str, group: list[str], gap: float = -1) -> DataFrame:
    return pairs(df, key, seq, group).select(*group, "id_i", "id_j", seq_dist(F.col("seq_i"), F.col("seq_j"), gap).alias("dist"))


def pairwise_equal(df: DataFrame, key: str, seq: str, group: list[str]) -> DataFrame:
    return pairs(df, key, seq, group).select(*group, "id_i", "id_j", seq_equal(F.col("seq_i"), F.col("seq_j")).alias("equal"))


def distance_matrix(spark, kind: str = "dna", gap: float | None = None) -> DataFrame:
    chars, of, g = (DNA_CHARS, dna_distance, -1 if gap is None else gap) if kind == "dna" else (AA_CHARS, aa_distance, 0 if gap is None else gap)
    return spark.createDataFrame([(a, b, float(of(a, b, g))) for a in chars for b in chars], "c1 string, c2 string, dist double")


def nonsquare_dist(df: DataFrame, key: str, seq: str, group: list[str], subset: Column, gap: float = -1) -> DataFrame:
    """group, id_i, id_j, dist from every sequence of the subset to all of its group (0 to itself); lengths must agree."""
    a = df.filter(subset).select(*group, F.col(key).alias("id_i"), F.col(seq).alias("seq_i"))
    both = a.join(df.select(*group, F.col(key).alias("id_j"), F.col(seq).alias("seq_j")), group)
    return both.select(*group, "id_i", "id_j", F.when(F.col("id_i") == F.col("id_j"), F.lit(0.0)).otherwise(seq_dist(F.col("seq_i"), F.col("seq_j"), gap)).alias("dist"))


def informative(seq: Column, ignore: str = "N-.?") -> Column:
    return F.char_length(F.translate(seq, ignore, ""))


def collapse_duplicates(df: DataFrame, key: str, seq: str, group: list[str], text: list[str] = (), num: list[str] = (), seqs: list[str] = (), sep: str = ",") -> DataFrame:
    """One row for each class of equal sequences of a group; sequences whose neighbours aren't all equal are ambiguous and leave.

    A sequence is unambiguous if its neighbourhood is a clique; then all of its unambiguous
    neighbours have the same one, so the class is named by its least member: no components
    are needed. Kept: the row with most informative characters (least key on ties), with the
    merged fields: text (distinct parts in order), num (sums) and seqs (the most informative). Pairs are taken
    between distinct sequences only.
    """
    d = df.groupBy(*group, seq).agg(F.min(key).alias("_s"))
    p = pairs(d, "_s", seq, group).filter(seq_equal(F.col("seq_i"), F.col("seq_j"))).select("id_i", "id_j")
    near = p.union(p.select("id_j", "id_i")).union(d.select("_s", "_s")).toDF("i", "j")
    degree = near.groupBy("i").agg(F.count(F.lit(1)).alias("deg"), F.min("j").alias("_class"))
    two = near.alias("a").join(near.alias("b"), F.col("a.j") == F.col("b.i")).select(F.col("a.i").alias("i"), F.col("a.j").alias("j"), F.col("b.j").alias("k"))
    inside = two.join(near.select(F.col("i"), F.col("j").alias("k")), ["i", "k"]).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    clear = degree.join(inside, "i").filter(F.col("n") == F.col("deg") * F.col("deg")).select(F.col("i").alias("_s"), "_class")
    rows = df.join(d, [*group, seq]).join(clear, "_s")
    best = F.struct(-informative(F.col(seq)), F.col(key))
    parts = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split(F.col(c).cast("string"), sep))))), sep)
    one = F.count(F.lit(1)) == 1
    merged = {c: F.when(one, F.first(F.col(c).cast("string"))).otherwise(F.when(F.count(c) > 0, parts(c))) for c in text}
    merged |= {c: F.sum(c) for c in num} | {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(informative(F.col(c)), F.col(c)))) for c in seqs}
    kept = [c for c in df.columns if c not in group]
    out = rows.groupBy(*group, "_class").agg(F.min_by(F.struct(*kept), best).alias("_row"), *[m.alias(f"_m{i}") for i, m in enumerate(merged.values())], F.count(F.lit(1)).alias("collapse_count"))
    place = {c: f"_m{i}" for i, c in enumerate(merged)}
    return out.select(*group, *[F.col(place[c]).alias(c) if c in place else F.col(f"_row.{c}").alias(c) for c in kept], "collapse_count")
