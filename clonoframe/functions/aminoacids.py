"""Amino-acid properties as Column expressions over counts of residues (no UDF); null text counts as empty, undefined is null."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BULKINESS, HYDROPATHY, PK, POLARITY

VALID = r"^[ARNDCQEGHILKMFPSTWYVX.*-]*$"


def _text(seq: Column) -> Column:
    return F.coalesce(seq, F.lit(""))


def count(seq: Column, letters: str) -> Column:
    return F.char_length(_text(seq)) - F.char_length(F.translate(_text(seq), letters, ""))


def informative(seq: Column) -> Column:
    return F.char_length(F.translate(_text(seq), "X.*-", ""))


def score(seq: Column, table: dict[str, float]) -> Column:
    """Mean of the table over residues other than X, gaps and stops; null if a residue has none or nothing is left."""
    total = sum((F.lit(v) * count(seq, k) for k, v in table.items()), F.lit(0.0))
    known = sum((count(seq, k) for k in table), F.lit(0))
    return F.when(known == informative(seq), F.try_divide(total, informative(seq)))


def gravy(seq):
    return score(seq, HYDROPATHY)


def bulk(seq):
    return score(seq, BULKINESS)


def polar(seq):
    return score(seq, POLARITY)


def aliphatic(seq, normalize: bool = True):
    x = count(seq, "A") + 2.9 * count(seq, "V") + 3.9 * count(seq, "LI")
    return F.try_divide(x, informative(seq)) if normalize else x


def charge(seq, ph: float = 7.4, pk: dict | None = None, normalize: bool = False):
    pk = pk or PK
    up = sum((count(seq, a) * F.lit(1 / (1 + 10 ** (ph - pk[a]))) for a in "RHK"), F.lit(0.0))
    down = sum((count(seq, a) * F.lit(1 / (1 + 10 ** -(ph - pk[a]))) for a in "DECY"), F.lit(0.0))
    return F.try_divide(up - down, informative(seq)) if normalize else up - down


def is_valid(seq):
    return F.coalesce(seq.rlike(VALID), F.lit(False))


def count_patterns(seq, patterns: dict[str, str]) -> dict[str, Column]:
    return {k: F.try_divide(F.regexp_count(_text(seq), F.lit(p)), F.char_length(_text(seq))) for k, p in patterns.items()}


def properties(seq: Column, label: str) -> dict[str, Column]:
    """The nine properties of valid sequences; others have nulls."""
    part = lambda letters: F.try_divide(count(seq, letters), informative(seq))
    made = {
        "length": F.char_length(_text(seq)).cast("double"), "gravy": gravy(seq), "bulk": bulk(seq), "aliphatic": aliphatic(seq), "polarity": polar(seq),
        "charge": charge(seq), "basic": part("RHK"), "acidic": part("DE"), "aromatic": part("FWHY"),
    }
    ok = _text(seq).rlike(VALID)
    return {f"{label}_aa_{k}": F.when(ok, v) for k, v in made.items()}
