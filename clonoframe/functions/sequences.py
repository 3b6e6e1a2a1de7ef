"""Sequence functions: built-in expressions for masks and regions, Arrow functions for work on single characters."""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..constants import IMGT_REGIONS, IUPAC_AA, IUPAC_DNA, codon

_BASES = list(IUPAC_DNA)
_CODE = np.full(256, -1, np.int64)
for _i, _b in enumerate(_BASES):
    _CODE[[ord(_b), ord(_b.lower())]] = _i
_TABLE = np.array([ord(codon(a + b + c)) for a in _BASES for b in _BASES for c in _BASES], np.uint8)
GAPS = "-."


def _flat(x: pa.Array):
    x = x.cast(pa.large_string())
    off = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int64)
    data = np.frombuffer(x.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


@arrow_udf(T.StringType())
def _translate(x: pa.Array) -> pa.Array:
    data, off = _flat(pa.compute.fill_null(x, ""))
    n = np.diff(off) // 3
    at = np.repeat(off[:-1] - 3 * (np.cumsum(n) - n), n) + 3 * np.arange(n.sum())
    c = [_CODE[data[at + k]] for k in range(3)]
    out = np.where((c[0] < 0) | (c[1] < 0) | (c[2] < 0), ord("X"), _TABLE[c[0] * 225 + c[1] * 15 + c[2]]).astype(np.uint8)
    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    made = pa.StringArray.from_buffers(len(n), pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes()))
    return pa.compute.if_else(pa.array(n > 0), made, pa.scalar(None, pa.string()))


def translate_dna(seq: Column, trim: bool = False) -> Column:
    """Residues of full codons; gaps read as N, unknown codons as X; null under three bases."""
    if trim:
        seq = F.substring(seq, F.lit(4), F.greatest(F.char_length(seq) - 6, F.lit(0)))
    return _translate(F.translate(seq, GAPS, "NN"))


def mask_gaps(seq: Column, mask: str = "N", outer_only: bool = False) -> Column:
    if not outer_only:
        return F.translate(seq, GAPS, mask * 2)
    left = F.regexp_extract(seq, r"^[-.]*", 0)
    rest = F.substring(seq, F.char_length(left) + 1, F.char_length(seq))
    right = F.regexp_extract(rest, r"[-.]*$", 0)
    return F.concat(F.repeat(F.lit(mask), F.char_length(left)), F.substring(rest, F.lit(1), F.char_length(rest) - F.char_length(right)), F.repeat(F.lit(mask), F.char_length(right)))


def extract_region(seq: Column, region: str) -> Column:
    a, b = IMGT_REGIONS[region]
    return F.substring(seq, a, b - a + 1)


def dna_distance(a: str, b: str, gap: float = -1) -> float:
    """Distance of two characters: codes that share a base are equal; `?` equals only itself."""
    ga, gb = a in GAPS, b in GAPS
    if ga or gb:
        return 0 if ga and gb else 1 if "?" in (a, b) else gap
    if "?" in (a, b):
        return 0 if a == b else 1
    return 0 if set(IUPAC_DNA[a]) & set(IUPAC_DNA[b]) else 1


def aa_distance(a: str, b: str, gap: float = 0) -> float:
    if a in GAPS or b in GAPS:
        return gap
    return 0 if set(IUPAC_AA[a]) & set(IUPAC_AA[b]) else 1


DNA_CHARS, AA_CHARS = [*_BASES, "-", ".", "?"], [*sorted(IUPAC_AA), "-", "."]
_DIST = np.full((256, 256), np.nan)
for _x in DNA_CHARS:
    for _y in DNA_CHARS:
        _DIST[ord(_x), ord(_y)] = dna_distance(_x, _y)


def seq_dist(a: Column, b: Column, gap: float = -1) -> Column:
    """Sum of positive distances, and one for each run of gaps against bases (gap -1); gap 0 ignores gaps. Lengths must agree."""
    table = np.where(_DIST == -1, gap, _DIST)

    @arrow_udf(T.DoubleType())
    def dist(x: pa.Array, y: pa.Array) -> pa.Array:
        known = pa.compute.and_(x.is_valid(), y.is_valid())
        p, off = _flat(pa.compute.if_else(known, x, ""))
        q, other = _flat(pa.compute.if_else(known, y, ""))
        if not np.array_equal(off, other):
            raise ValueError("sequences must have equal lengths")
        d = table[p, q]
        if np.isnan(d).any():
            raise ValueError("unknown character")
        gap_ = d == -1
        # A run of gaps counts at its first place, which may be a sequence's first.
        follows = np.zeros(len(d), bool)
        follows[1:] = gap_[:-1]
        follows[off[:-1][off[:-1] < len(d)]] = False
        total = np.concatenate([[0.0], np.cumsum(np.where(d > 0, d, 0.0) + (gap_ & ~follows))])
        return pa.array(total[off[1:]] - total[off[:-1]], pa.float64(), mask=~known.to_numpy(zero_copy_only=False))

    return dist(a, b)


def seq_equal(a: Column, b: Column, ignore: str = "N-.?") -> Column:
    """Equal length, and equal at every place where neither has an ignored character."""
    pairs = F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    same = F.forall(pairs, lambda p: (p["x"] == p["y"]) | p["x"].isin(*ignore) | p["y"].isin(*ignore))
    return (F.char_length(a) == F.char_length(b)) & same
