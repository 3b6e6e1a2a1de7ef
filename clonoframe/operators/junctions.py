"""Germline bases deleted around the junction, and those of V and J that the CDR3 holds."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genes import get_allele

#: Fixed value: the place at which the junction begins in the standard numbering.
JUNCTION = 310


def _bases(x: Column, gaps: str = ".-") -> Column:
    return F.char_length(F.translate(x, gaps, ""))


def _part(x: Column, first: Column, last: Column) -> Column:
    """Places first to last (from 1, both included; none if last is before first)."""
    first = F.greatest(first, F.lit(1))
    return F.substring(x, first, F.greatest(last - first + 1, F.lit(0)))


def junction_alignment(
    df: DataFrame, germlines: DataFrame, v_call: str = "v_call", d_call: str = "d_call", j_call: str = "j_call", prefix: str = "{}_germline_{}",
    junction: str = "junction", junction_length: str = "junction_length", alignment: str = "sequence_alignment",
) -> DataFrame:
    """Adds e3v_length, e5d_length, e3d_length, e5j_length, v_cdr3_length and j_cdr3_length.

    germlines has allele and germline; it is joined once for each gene, and the optimizer
    broadcasts it where its size allows. An allele that it lacks is an error; a null call, and
    for the CDR3 a null junction or one of six bases or fewer, gives null.
    """
    ref = germlines.select(F.col("allele").alias("_allele"), F.col("germline").alias("_germline"))
    x, made = df, {}
    for g, call in (("v", v_call), ("d", d_call), ("j", j_call)):
        allele = get_allele(F.col(call))
        x = x.withColumn(f"_{g}a", allele).join(ref.withColumnsRenamed({"_allele": f"_{g}k", "_germline": f"_{g}g"}), F.col(f"_{g}a") == F.col(f"_{g}k"), "left").drop(f"_{g}k")
        known = F.when(F.col(f"_{g}a").isNotNull() & F.col(f"_{g}g").isNull(), F.raise_error(F.concat(F.col(f"_{g}a"), F.lit(" isn't among the germlines")))).otherwise(F.col(f"_{g}g"))
        start, end = (F.col(prefix.format(g, e)).cast("int") for e in ("start", "end"))
        made[f"{g}_head"] = _bases(_part(known, F.lit(1), start - 1), ".")
        made[f"{g}_tail"] = _bases(_part(known, end + 1, F.char_length(known)), ".")
    aln = F.col(alignment)
    size, length = F.char_length(aln), F.col(junction_length).cast("int")
    # The place before the first base that the junction has no more.
    # (The shortest beginning with one base more than the junction; the pattern has no group to repeat.)
    bases = F.regexp_replace(F.substring(aln, F.lit(JUNCTION), F.greatest(size, F.lit(0))), "([^.-])", "$1\u0001")
    upto = F.call_function("substring_index", bases, F.lit("\u0001"), length + 1)
    junction_end = F.when(_bases(_part(aln, F.lit(JUNCTION), size)) > length, JUNCTION + F.char_length(F.translate(upto, "\u0001", "")) - 2).otherwise(size)
    told = F.col(junction).isNotNull() & (length > 6)
    span = lambda g: F.col(prefix.format(g, "end")).cast("int") - F.col(prefix.format(g, "start")).cast("int") + 1
    v = _bases(_part(aln, F.lit(JUNCTION + 3), span("v")))
    j = _bases(_part(aln, size - span("j") + 1, junction_end - 3), "-")
    out = {
        "e3v_length": made["v_tail"], "e5d_length": made["d_head"], "e3d_length": made["d_tail"], "e5j_length": made["j_head"],
        "v_cdr3_length": F.when(told & F.col("_va").rlike("[Vv]"), v), "j_cdr3_length": F.when(told & F.col("_ja").rlike("[Jj]"), j),
    }
    return x.withColumns(out).drop(*[f"_{g}{e}" for g in "vdj" for e in "ag"])
