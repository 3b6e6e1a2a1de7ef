"""Base qualities on alignment coordinates, as expressions over the few hundred places of a sequence.

A CIGAR string says which places of the read the alignment holds; pseudo-segments of N/P
bases lie between the genes. Undefined inputs (a null alignment, no segment) give null.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions.quality import explode_cigar, mask_by_quality
from ..functions.sequences import GAPS, _flat

_SPANS = "array<struct<a:int,b:int>>"


def segment_places(cigar: Column) -> Column:
    """Spans (first, last place of the read) of the matched runs of a CIGAR string: =, X and M; S and D are passed over, N and I don't count."""
    steps = F.filter(explode_cigar(cigar), lambda s: ~s["op"].isin("N", "I"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        to = acc["at"] + F.when(s["op"].isin("S", "=", "X", "D", "M"), s["n"]).otherwise(0)
        one = F.array(F.struct((acc["at"] + 1).alias("a"), to.alias("b")))
        return F.struct(to.alias("at"), F.when(s["op"].isin("=", "X", "M") & (s["n"] > 0), F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(steps, start, step, lambda acc: acc["spans"])


def read_places(v_cigar: str, d_cigar: str, j_cigar: str, np1: str, np2: str, v_end: str, d_end: str) -> Column:
    """Places of the read in the order of the alignment's bases."""
    none = F.array().cast(_SPANS)

    def between(n: str, end: str) -> Column:
        a, k = F.col(end).cast("int"), F.col(n).cast("int")
        return F.when(k > 0, F.array(F.struct((a + 1).alias("a"), (a + k).alias("b")))).otherwise(none)

    parts = [segment_places(F.col(v_cigar)), between(np1, v_end), segment_places(F.col(d_cigar)), between(np2, d_end), segment_places(F.col(j_cigar))]
    spans = F.concat(*[F.coalesce(p.cast(_SPANS), none) for p in parts])
    return F.flatten(F.transform(spans, lambda s: F.sequence(s["a"], s["b"])))


def alignment_quality(
    df: DataFrame, sequence: str = "sequence", alignment: str = "sequence_alignment", quality: str = "quality", quality_num: str = "quality_num",
    v_cigar: str = "v_cigar", d_cigar: str = "d_cigar", j_cigar: str = "j_cigar", np1: str = "np1_length", np2: str = "np2_length",
    v_end: str = "v_sequence_end", d_end: str = "d_sequence_end", style: str = "both",
) -> DataFrame:
    """Adds quality_alignment_num (comma-separated, NA at gaps) and quality_alignment (characters, spaces at gaps).

    A row whose bases by the CIGAR strings aren't those of its alignment is an error, as in
    the published tools; a row without a quality gets nulls.
    """
    if style not in ("num", "ascii", "both"):
        raise ValueError("style must be num, ascii or both")
    places = read_places(v_cigar, d_cigar, j_cigar, np1, np2, v_end, d_end)
    nums = F.transform(F.split(F.col(quality_num), ","), lambda q: F.regexp_replace(F.when(q == "", F.lit("NA")).otherwise(q), r"\.0+$", ""))
    given = {"quality_alignment_num": (nums, "NA", ","), "quality_alignment": (F.split(F.col(quality), ""), " ", "")}
    kept = {"num": ["quality_alignment_num"], "ascii": ["quality_alignment"], "both": list(given)}[style]
    x = df.withColumn("_p", places)
    return x.withColumns({c: at_places(*given[c][1:])(F.col(alignment), F.col(sequence), F.col("_p"), given[c][0]) for c in kept}).drop("_p")


def at_places(gap: str, sep: str):
    """An Arrow function: values (by place of the read) at the alignment's bases and gap elsewhere, joined by sep; a whole batch at a time."""

    @arrow_udf(T.StringType())
    def run(alignment: pa.Array, sequence: pa.Array, places: pa.Array, values: pa.Array) -> pa.Array:
        known = pc.and_(pc.and_(alignment.is_valid(), sequence.is_valid()), pc.and_(places.is_valid(), values.is_valid()))
        alignment, sequence, places, values = (c.filter(known) for c in (alignment, sequence, places, values))
        (data, off), (read, start) = _flat(alignment), _flat(sequence)
        base = ~np.isin(data, np.frombuffer(GAPS.encode(), np.uint8))
        upto = np.concatenate([[0], np.cumsum(base)])
        n = np.diff(upto[off])
        place, of = pc.list_flatten(places).to_numpy().astype(np.int64), pc.list_value_length(places).to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        fits = np.array_equal(n, of) and bool((place >= 1).all() and (place <= np.diff(start)[row]).all())
        if not fits or not np.array_equal(read[start[row] + place - 1], data[base]):
            raise ValueError("the bases by CIGAR aren't those of the alignment")
        size = pc.list_value_length(values).to_numpy()
        if (place > size[row]).any():
            raise ValueError("a read has fewer qualities than bases")
        picked = pc.list_flatten(values).take(pa.array((np.cumsum(size) - size)[row] + place - 1))
        cells = pc.fill_null(picked.take(pa.array(upto[1:] - 1, mask=~base)), gap)
        made = pc.binary_join(pa.ListArray.from_arrays(pa.array(off, pa.int32()), cells), sep)
        flags = known.to_numpy(zero_copy_only=False)
        return made.take(pa.array(np.cumsum(flags) - 1, mask=~flags))

    return run


def position_quality(df: DataFrame, key: str = "sequence_id", sequence: str = "sequence_alignment", quality_num: str = "quality_alignment_num") -> DataFrame:
    """position (from 1), the quality (double, null for NA), key and nt: a row for each place; lengths that differ are an error."""
    q = F.split(F.col(quality_num), ",")
    q = F.when(F.size(q) == F.char_length(sequence), q).otherwise(F.raise_error(F.concat(F.lit("different length, for sequence: "), F.col(key).cast("string"))))
    x = df.filter(F.col(sequence).isNotNull() & F.col(quality_num).isNotNull()).select(F.col(key), F.col(sequence).alias("_s"), F.posexplode(q).alias("_i", "_q"))
    return x.select((F.col("_i") + 1).alias("position"), F.when(F.col("_q").isin("NA", ""), None).otherwise(F.col("_q")).cast("double").alias(quality_num), F.col(key), F.substring(F.col("_s"), F.col("_i") + 1, F.lit(1)).alias("nt"))


def mask_positions(df: DataFrame, min_quality: float = 70, sequence: str = "sequence_alignment", quality_num: str = "quality_alignment_num") -> DataFrame:
    """Adds <sequence>_masked, N at every place of a lower quality."""
    return df.withColumn(f"{sequence}_masked", mask_by_quality(F.col(sequence), F.col(quality_num), min_quality))
