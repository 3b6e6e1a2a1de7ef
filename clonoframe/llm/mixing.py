"""Mixing sources to target weights by systematic sampling.

Each document's expected copies are its source's rate, target over size. Within a source
the expected copies are summed along an order by size, one offset per source is added, and
a document is emitted once for every integer the running sum crosses. As sizes only grow
along the order, the words taken differ from the target by at most one longest document; of
DRAWS offsets, evenly spread from one drawn by hash, the nearest is kept, which leaves far less.

Defined cases: null or empty text has size 0 and is never emitted with words; a null source
is a source of its own, last in order; a source without words has target 0; repeated rows
are sampled one by one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, ranked

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Offsets tried for each source; the one whose words come nearest the target is taken (the first of equal ones).
DRAWS = 64
#: A source gives at most so many times its own size.
MOST = 3


def word_count(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; 0 for null."""
    spaced = F.translate(text, SPACES, " " * len(SPACES))
    # A word ends wherever a space follows a character that is none, and at the end.
    return F.coalesce(F.regexp_count(spaced, F.lit("[^ ]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """source, source_size -> with target: shares of the total by weight, stopped at MOST times
    the source's size, the excess reshared by weight. Each round is one aggregate over the
    sources; only its sums reach the driver."""
    sources = ranked(sources, scratch, "source-order", [], [F.col("source").asc_nulls_last()], "_at_")
    weights = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod("_at_", F.lit(len(WEIGHTS))) + 1).cast("int"))
    sources = scratch.write(sources.select("source", "source_size", weights.alias("weight"), (F.col("source_size") * MOST).alias("most")), "sources")
    level = 0.0
    while True:
        stopped = F.col("most") <= F.col("weight") * F.lit(level)
        total, full, open_weight = sources.agg(F.sum("source_size"), F.sum(F.when(stopped, F.col("most"))), F.sum(F.when(~stopped, F.col("weight")))).first()
        now = (total - (full or 0)) / open_weight if open_weight else level
        if now <= level:
            break
        level = now
    return sources.withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level)))


def mix_sources(docs: DataFrame, seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, size (words), source_size, target, copies, taken (copies times size), and `keep`.

    One shuffle deals the narrow rows by range over (source, size, hash), so that a hot
    source is spread over tasks; its ranks come from per-run counts. The offset of a source
    is a hash of the seed and its name: reruns agree.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    rows = scratch.write(rows, "sizes")  # the range exchange reads its input twice
    place = F.xxhash64(F.lit(seed), F.col("_key"))
    rows = ranked(rows, scratch, "rows", ["source"], [F.col("size"), place, F.col("_key")], "_rank")
    sources = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), scratch)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = sources.select(F.col("source").alias("_source"), "source_size", "target", rate.alias("_rate"))
    on = F.col("source").eqNullSafe(F.col("_source"))
    begin = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("_source", F.lit("\x00none"))), F.lit(1 << 52)) / F.lit(float(1 << 52))
    offset = lambda i: F.pmod(begin + i / F.lit(float(DRAWS)), F.lit(1.0))

    def copies(offset: Column) -> Column:
        until = lambda n: F.floor(offset + F.col("_rate") * n)
        return F.least(until(F.col("_rank") + 1) - until(F.col("_rank")), F.lit(MOST)).cast("long")

    tried = rows.join(sources, on).select("_source", "target", "size", "_rank", "_rate", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))).alias("_i"))
    tried = tried.groupBy("_source", "_i").agg(F.first("target").alias("_t"), F.sum(copies(offset(F.col("_i"))) * F.col("size")).alias("_w"))
    best = tried.groupBy(F.col("_source").alias("_b")).agg(F.min(F.struct(F.abs(F.col("_w") - F.col("_t")).alias("off"), F.col("_i").alias("i"))).alias("_best"))
    sources = sources.join(best, F.col("_source").eqNullSafe(F.col("_b"))).withColumn("_offset", offset(F.col("_best.i")))
    sources = scratch.write(sources.drop("_b", "_best"), "offsets")
    rows = rows.join(sources, on)
    n = copies(F.col("_offset"))
    return rows.select(
        F.col("_key").alias(key), "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"),
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
    )
