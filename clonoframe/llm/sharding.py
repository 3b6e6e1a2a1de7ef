"""Sharding by a k-d tree over document metadata.

A node that is to hold several shards is split at the weighted median (the quantile that
its number of shards asks for) along its widest metadata dimension, until each leaf is one
shard of about the target bytes. The unit that moves is a group of equal texts, so copies
share a shard; only a group above a quarter of a shard is divided, by row hash, for
otherwise no sizes near equal exist.

A median is found by rounds of histograms, each one distributed aggregate over all nodes
of a level, to 2**-16 of the dimension's width and then 2**-17 of the tied rows. At most
2**20 bins reach the driver, whatever the input.

Defined cases: null text counts as no bytes (size 1, CRC 0) and all null and empty texts are
one group; null metadata sort first; units at one place of a dimension are cut by a hash, and of rows at
one key the slots go by the text's hash; repeated rows are rows of their own; an empty table
gives no rows; extra columns are ignored unless named in keep.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ranked, small_table

_DIMS = ("d0", "d1", "d2")
_DIM_BITS, _TIE_BITS = 16, 17
_UNIT = ["crc", "text_hash", "size", "part"]


def _places(groups: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """value, place: the different values of a string column in code point order, nulls first, as whole numbers from 0."""
    return ranked(groups.select(F.col(f"first.{name}").alias("value")).distinct(), scratch, f"values-{name}", [], [F.col("value").asc_nulls_first()], "place")


def _quantile_cuts(live: DataFrame, want: dict[int, float], bits: int) -> dict[int, int]:
    """For each node the cut along `place` (whole numbers below 2**bits) with about `want` weight below it."""
    spark = live.sparkSession
    base, seen = dict.fromkeys(want, 0), dict.fromkeys(want, 0.0)
    left = bits
    each = max(4, min(11, 20 - math.ceil(math.log2(len(want) + 1))))
    while left:
        step = max(0, left - each)
        low = F.broadcast(small_table(spark, [(k, int(v)) for k, v in base.items()], "node int, low long"))
        bins = live.join(low, "node").withColumn("bin", F.shiftright(F.col("place") - F.col("low"), step))
        bins = bins.filter((F.col("place") >= F.col("low")) & (F.col("bin") < (1 << (left - step)))).groupBy("node", "bin").agg(F.sum("weight").alias("w"))
        found: dict[int, list] = {}
        for r in bins.collect():
            found.setdefault(r["node"], []).append((r["bin"], float(r["w"])))
        for k in want:
            at = 1 << (left - step)  # past the last bin
            for b, w in sorted(found.get(k, [])):
                if seen[k] + w > want[k]:
                    at = b
                    if not step and want[k] - seen[k] > seen[k] + w - want[k]:
                        at += 1
                    break
                seen[k] += w
            base[k] += min(at, (1 << (left - step)) - (1 if step else 0)) << step
        left = step
    return base


def _leaves(units: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    """units (with weight, d0..d2 in [0, 1), tie below 2**_TIE_BITS) -> with node, the number of its shard."""
    spark = units.sparkSession
    nodes, state, level = {0: shards}, scratch.write(units.withColumn("node", F.lit(0)), "level0"), 0
    while active := [k for k, n in nodes.items() if n > 1]:
        ends = state.filter(F.col("node").isin(active) if len(active) < 50 else F.lit(True)).groupBy("node").agg(F.sum("weight").alias("w"), *[f(d).alias(f"{x}_{d}") for d in _DIMS for x, f in (("lo", F.min), ("hi", F.max))]).collect()
        ends = {r["node"]: r for r in ends if r["node"] in set(active)}
        if not ends:
            break
        rows, want = [], {}
        for k, r in ends.items():
            d = max(_DIMS, key=lambda d: r[f"hi_{d}"] - r[f"lo_{d}"])  # noqa: B023
            rows.append((k, _DIMS.index(d), float(r[f"lo_{d}"]), float(max(r[f"hi_{d}"] - r[f"lo_{d}"], 1e-12))))
            want[k] = float(r["w"]) * (nodes[k] // 2) / nodes[k]
        axis = F.broadcast(small_table(spark, rows, "node int, dim int, lo double, width double"))
        along = (F.element_at(F.array(*_DIMS), F.col("dim") + 1) - F.col("lo")) / F.col("width") * F.lit(float(1 << _DIM_BITS))
        place = F.shiftleft(F.least(F.floor(along), F.lit((1 << _DIM_BITS) - 1)).cast("long"), _TIE_BITS) + F.col("tie")
        live = state.join(axis, "node").select("node", "weight", place.alias("place"))
        cuts = _quantile_cuts(live, want, _DIM_BITS + _TIE_BITS)
        rows = [(*r, int(cuts[r[0]]), r[0] + nodes[r[0]] // 2) for r in rows]
        axis = F.broadcast(small_table(spark, rows, "node int, dim int, lo double, width double, cut long, upper int"))
        moved = F.when(place >= F.col("cut"), F.col("upper")).otherwise(F.col("node"))
        state = state.join(axis, "node", "left").withColumn("node", F.when(F.col("cut").isNull(), F.col("node")).otherwise(moved)).drop("dim", "lo", "width", "cut", "upper")
        for k in active:
            half = nodes[k] // 2
            nodes[k], nodes[k + half] = half, nodes[k] - half
        level += 1
        if level % 3 == 0:
            state = scratch.write(state, f"level{level}")
    return state


def kd_shards(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, size (UTF-8 bytes plus 1), text_crc32, law (`bytes`), shard, slot (gapless
    from 0 in the shard), grown_shard (null under this law), and `keep`.

    The dimensions are the places of source and language in the order of all their values, and
    the logarithm of the size, each over its whole width; a group of copies has those of its smallest key. Number of shards: `shards`, or
    else what brings each leaf to target_bytes.
    """
    scratch = Scratch(docs.sparkSession, "shard")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    held = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("_key"), size.alias("size"), F.crc32(held.cast("binary")).alias("crc"), F.xxhash64(held).alias("text_hash"),
        F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)],
    )
    rows = scratch.write(rows, "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    if shards is None:
        shards = max(1, math.ceil(total / (target_bytes or 1 << 30)))
    groups = scratch.write(
        rows.groupBy("crc", "text_hash", "size").agg(F.sum("size").alias("weight"), F.min(F.struct("_key", "source", "lang")).alias("first")), "groups"
    )
    most = max(1.0, total / shards / 4)
    large = groups.filter(F.col("weight") > most).select("crc", "text_hash", F.ceil(F.col("weight") / F.lit(most / 4)).cast("int").alias("parts"))
    # At most four such groups fit in a shard's bytes, so there are at most 4 * shards of them.
    large = F.broadcast(small_table(docs.sparkSession, large.collect(), "crc long, text_hash long, parts int"))
    rows = rows.join(large, ["crc", "text_hash"], "left")
    part = F.coalesce(F.pmod(F.xxhash64(F.lit("part"), F.col("_key")), F.col("parts")), F.lit(0)).cast("int")
    rows = rows.withColumn("part", part).drop("parts")
    whole = groups.join(large, ["crc", "text_hash"], "left")
    whole = whole.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)))
    for i, name in enumerate(("source", "lang")):
        at = scratch.write(_places(groups, name, scratch).select(F.col("value").alias(f"_v{i}"), F.col("place").cast("double").alias(f"d{i}")), f"places-{name}")
        whole = whole.join(at, F.col(f"first.{name}").eqNullSafe(F.col(f"_v{i}"))).drop(f"_v{i}")
    units = whole.select(
        "crc", "text_hash", "size", "part", (F.col("weight") / F.coalesce("parts", F.lit(1))).alias("weight"), "d0", "d1", F.log2(F.col("size") + F.lit(1.0)).alias("d2"),
        F.pmod(F.xxhash64(F.lit("tie"), "crc", "text_hash", "part"), F.lit(1 << _TIE_BITS)).cast("long").alias("tie"),
    )
    span = units.agg(*[f(d).alias(f"{x}{d}") for d in _DIMS for x, f in (("lo", F.min), ("hi", F.max))]).first()
    # Each dimension over its whole width, so that the widest is the one least cut so far.
    units = units.withColumns({d: (F.col(d) - F.lit(float(span[f"lo{d}"] or 0))) / F.lit(float(max((span[f"hi{d}"] or 0) - (span[f"lo{d}"] or 0), 1e-12))) for d in _DIMS})
    leaf = _leaves(units, shards, scratch).select(*[F.col(c).alias(f"_{c}") for c in _UNIT], F.col("node").alias("shard"))
    rows = rows.join(leaf, [F.col(c) == F.col(f"_{c}") for c in _UNIT]).drop(*[f"_{c}" for c in _UNIT])
    rows = ranked(rows, scratch, "dealt", ["shard"], [F.col("_key"), F.col("text_hash")], "slot")
    return rows.select(
        F.col("_key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
    )
