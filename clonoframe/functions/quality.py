"""Base qualities and small helpers as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def explode_cigar(cigar: Column) -> Column:
    """Array of (op, length)."""
    ops, n = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2)), F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1))
    return F.zip_with(ops, n, lambda o, k: F.struct(o.alias("op"), k.cast("int").alias("n")))


def mask_by_quality(seq: Column, quality: Column, least: float = 70) -> Column:
    """N wherever the comma-separated quality is below least; missing qualities (NA) stay."""
    low = lambda q: F.coalesce(q.try_cast("double") < least, F.lit(False))
    return F.array_join(F.zip_with(F.split(seq, ""), F.split(quality, ","), lambda c, q: F.when(low(q), F.lit("N")).otherwise(c)), "")


def translate_strings(value: Column, rules: dict[str, list[str]]) -> Column:
    """Whole-string replacement, rule by rule."""
    for new, old in rules.items():
        value = F.when(value.isin(*([old] if isinstance(old, str) else old)), F.lit(new)).otherwise(value)
    return value
