"""Preparation of clones for lineages: masks, padding and collapsing of duplicates for all clones at once."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import genes
from ..functions.sequences import mask_gaps
from .sequences import collapse_duplicates, mask_ends, pad_ends


def make_clones(
    df: DataFrame, clone: str = "clone_id", key: str = "sequence_id", seq: str = "sequence_alignment", germ: str = "germline_alignment", v_call: str = "v_call",
    j_call: str = "j_call", junc_len: str = "junction_length", mask: str = "N", locus: str | None = "locus", max_mask: int | None = 0, pad_end: bool = False,
    text: list[str] = (), num: list[str] = (), seqs: list[str] = (), add_count: bool = True,
) -> DataFrame:
    """clone_id, sequence_id, sequence, the merged fields (and collapse_count), germline, v_gene, j_gene, junc_len: the
    sequences of each clone without gaps, ragged ends and duplicates.

    What is one for a clone comes from its row of least key. A clone with another locus than
    IGH (or none), or, unless padded, with sequences of several lengths, is an error.
    """
    own = Window.partitionBy(clone)
    rows = df.withColumn(seq, mask_gaps(F.col(seq), mask))
    if locus and locus in df.columns:
        ok = F.min(F.coalesce((F.col(locus) == "IGH"), F.lit(False))).over(own)
        rows = rows.withColumn(seq, F.when(ok, F.col(seq)).otherwise(F.raise_error(F.lit("only IGH is allowed in the locus column"))))
    rows = mask_ends(rows, seq, [clone], mask, max_mask, out=seq)
    germline = mask_gaps(F.col(germ), mask)
    if pad_end:
        rows = pad_ends(rows, seq, [clone], pad=mask, out=seq)
        width = (F.ceil(F.char_length(germline) / 3) * 3).cast("int")
        germline = F.rpad(germline, width, mask)
    else:
        same = F.min(F.char_length(seq)).over(own) == F.max(F.char_length(seq)).over(own)
        rows = rows.withColumn(seq, F.when(same, F.col(seq)).otherwise(F.raise_error(F.lit("all sequences of a clone must have one length; try pad_end"))))
    first = lambda c: F.min_by(c, F.col(key))
    whole = df.groupBy(F.col(clone).alias("_clone")).agg(first(germline).alias("germline"), first(genes.get_gene(F.col(v_call))).alias("v_gene"), first(genes.get_gene(F.col(j_call))).alias("j_gene"), first(F.col(junc_len)).cast("int").alias("junc_len"))
    kept = rows.select(clone, key, seq, *text, *num, *seqs)
    out = collapse_duplicates(kept, key, seq, [clone], text, num, seqs).withColumnsRenamed({seq: "sequence", key: "sequence_id"})
    out = out if add_count else out.drop("collapse_count")
    return out.join(whole, F.col(clone).eqNullSafe(F.col("_clone"))).drop("_clone")
