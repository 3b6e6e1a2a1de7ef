"""Gene-call parsing as Column expressions; null calls stay null, calls without a match stay as they are."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of allele, gene, family and locus names.
ALLELE = r"((IG[HKL]|TR[ABDG])[VDJADEGMC][A-R0-9\(\)]*[-/\w]*[-\*]*[\.\w]+)"
GENE = r"((IG[HKL]|TR[ABDG])[VDJADEGMC][A-R0-9\(\)]*[-/\w]*)"
FAMILY = r"((IG[HKL]|TR[ABDG])[VDJADEGMC][A-R0-9\(\)]*)"
LOCUS = r"((IG[HLK]|TR[ABDG]))"
NON_LOCALIZED = r"(IG[HKL]|TR[ABDG])[VDJADEGMC][0-9]+-NL[0-9]"


def get_segment(call: Column, pattern: str, first: bool = True, collapse: bool = True, strip_d: bool = True, omit_nl: bool = False, sep: str = ",") -> Column:
    """The part of each call that the pattern names: the first, or the distinct ones in order (all, without collapse)."""
    around = f"[^{sep}]*"
    if omit_nl:
        call = F.regexp_replace(call, f"{around}{ALLELE}{around}", "$1")
        # Non-localized genes: a gene's name with a number before -NL and its number.
        call = F.regexp_replace(call, rf"[^{sep}]*{NON_LOCALIZED}[^{sep}]*({sep}|$)", "")
    out = F.regexp_replace(call, f"{around}{pattern}{around}", "$1")
    if strip_d:
        # Fixed value: the suffix D of a duplicated gene, after a letter or digit and a digit.
        out = F.regexp_replace(out, rf"(?<=[A-Z0-9][0-9])D(?=\*|-|{sep}|$)", "")
    if first:
        return F.regexp_replace(out, f"{sep}.*$", "")
    return F.array_join(F.array_distinct(F.split(out, sep)), sep) if collapse else out


def get_allele(call, **how):
    return get_segment(call, ALLELE, **how)


def get_gene(call, **how):
    return get_segment(call, GENE, **how)


def get_family(call, **how):
    return get_segment(call, FAMILY, **how)


def get_locus(call, **how):
    return get_segment(call, LOCUS, **how)


def get_chain(call, **how):
    return F.regexp_replace(F.regexp_replace(get_locus(call, **how), "IGH|TRB|TRD", "VH"), "IGK|IGL|TRA|TRG", "VL")
