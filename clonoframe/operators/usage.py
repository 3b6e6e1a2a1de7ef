"""Gene usage and clone counts: grouped aggregates and windowed shares (a share within a null group is null for clones)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import genes
from .components import components


def count_genes(df: DataFrame, gene: str, groups: list[str] | None = None, copy: str | None = None, clone: str | None = None, fill: bool = False, mode: str = "gene", **how) -> DataFrame:
    """Usage of genes by groups; shares are within (groups, locus). copy wins over clone; equal counts go by gene name."""
    groups = list(groups or [])
    call = {"gene": genes.get_gene, "allele": genes.get_allele, "family": genes.get_family, "asis": lambda c, **_: c}[mode](F.col(gene), **how)
    df = df.filter(F.col(gene).isNotNull()).withColumn("gene", call)
    df = df.withColumn("locus", F.substring("gene", 1, 3)) if "locus" not in df.columns else df
    by, of = [*groups, "locus", "gene"], Window.partitionBy(*groups, "locus")
    if copy:
        out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("seq_count"), F.sum(copy).alias("copy_count"))
        out = out.withColumns({"seq_freq": F.col("seq_count") / F.sum("seq_count").over(of), "copy_freq": F.col("copy_count") / F.sum("copy_count").over(of)})
        zero = ["seq_count", "copy_count", "seq_freq", "copy_freq"]
    elif clone:
        n = df.filter(F.col(clone).isNotNull()).groupBy(*by, clone).agg(F.count(F.lit(1)).alias("n"))
        top = n.groupBy(*groups, "locus", clone).agg(F.min_by("gene", F.struct(-F.col("n"), F.col("gene"))).alias("gene"))
        out = top.groupBy(*by).agg(F.count(F.lit(1)).alias("clone_count"))
        out = out.withColumn("locus_clone_count", F.sum("clone_count").over(of)).withColumn("clone_freq", F.col("clone_count") / F.col("locus_clone_count"))
        zero = ["clone_count", "clone_freq"]
    else:
        out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("seq_count"))
        out = out.withColumn("locus_count", F.sum("seq_count").over(of)).withColumn("seq_freq", F.col("seq_count") / F.col("locus_count"))
        zero = ["seq_count", "seq_freq"]
    if fill and groups:
        every = out.select("gene").distinct()
        for g in groups:
            every = every.crossJoin(F.broadcast(out.select(g).distinct()))  # group values and genes are small dimensions
        out = every.join(out.drop("locus"), [*groups, "gene"], "left").fillna(0, zero).withColumn("locus", F.substring("gene", 1, 3))
    return out


def sort_genes(df: DataFrame, gene: str, method: str = "name") -> DataFrame:
    """Distinct alleles with their rank by name or by position; alleles are a fixed vocabulary, so one window holds them."""
    a = df.select(F.explode(F.split(genes.get_allele(F.col(gene), first=False, strip_d=False), ",")).alias("allele")).distinct()
    number = lambda x: F.coalesce(F.try_to_number(F.when(x == "", None).otherwise(x), F.lit("99999999")).cast("int"), F.lit(0))
    digits = lambda p: number(F.regexp_replace(F.regexp_extract("allele", p, 1), r"[^0-9]+", "99"))
    a = a.withColumns({"family": genes.get_family(F.col("allele"), strip_d=False), "g1": digits(r"-([^-*]+)"), "g2": digits(r"-[^-*]+-([^-*]+)"), "a1": digits(r"\*(\w+)")})
    order = [F.col("family"), F.col("g1"), F.col("g2"), F.col("a1"), F.col("allele")] if method == "name" else [F.col("g1").desc(), F.col("g2").desc(), F.col("family"), F.col("a1"), F.col("allele")]
    return a.select("allele", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def count_clones(df: DataFrame, groups: list[str] | None = None, copy: str | None = None, clone: str = "clone_id") -> DataFrame:
    groups = list(groups or [])
    out = df.filter(F.col(clone).isNotNull()).groupBy(*groups, clone).agg(F.count(F.lit(1)).alias("seq_count"), *([F.sum(copy).alias("copy_count")] if copy else []))
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    whole = lambda c: F.sum(c).over(w)
    ok = F.lit(True)
    for g in groups:
        ok = ok & F.col(g).isNotNull()
    out = out.withColumn("seq_freq", F.when(ok, F.col("seq_count") / whole("seq_count")))
    return out.withColumn("copy_freq", F.when(ok, F.col("copy_count") / whole("copy_count"))) if copy else out


# The loci that single cells may have.
HEAVY, LIGHT = ("IGH", "TRB", "TRD"), ("IGK", "IGL", "TRA", "TRG")
LOCI = ("IGH", "IGI", "IGK", "IGL", "TRA", "TRB", "TRD", "TRG")


def vj_tokens(v_call: str, j_call: str, junc_len: str | None = None, first: bool = False) -> Column:
    """All V@J (or V@J@length) of a row: chains are separated by ; and go together one to one, calls of a chain by a comma."""
    genes_of = lambda c: F.split(genes.get_gene(c, first=first), ",")
    v, j = F.split(F.col(v_call), ";"), F.split(F.col(j_call), ";")
    n = F.split(F.col(junc_len).cast("string"), ";") if junc_len else F.transform(v, lambda _: F.lit(""))
    one = lambda a, b, k: F.flatten(F.transform(genes_of(a), lambda x: F.transform(genes_of(b), lambda y: F.concat(x, F.lit("@"), y, F.concat(F.lit("@"), k) if junc_len else k))))
    each = F.transform(F.arrays_zip(v.alias("v"), j.alias("j"), n.alias("n")), lambda c: one(c["v"], c["j"], c["n"]))
    same = F.size(v) == F.size(j)
    return F.when(same, F.array_sort(F.array_distinct(F.flatten(each)))).otherwise(F.raise_error(F.lit("V and J calls must have chains one to one")))


def _cells(df: DataFrame, v_call: str, j_call: str, junc_len: str | None, cell_id: str, locus: str) -> DataFrame:
    """A row for each cell (null: all rows without one) with its heavy chains' calls joined by ;; what can't be a cell is an error."""
    is_in = lambda c, names: F.coalesce(F.col(c).isin(*names), F.lit(False))
    by = df.groupBy(F.col(cell_id).alias("_cell")).agg(F.count(F.when(is_in(locus, HEAVY), 1)).alias("heavy"), F.count(F.when(is_in(locus, LIGHT), 1)).alias("light"), F.count(F.when(F.col(locus).isNotNull() & ~is_in(locus, LOCI), 1)).alias("other"))
    told = by.agg(F.max((F.col("_cell").isNull()).cast("int")), F.max("heavy"), F.max(((F.col("heavy") == 0) & (F.col("light") > 0)).cast("int")), F.sum("other")).first()
    if told[3]:
        raise ValueError("the locus column has values that are no loci")
    if told[0] == 0 and (told[1] or 0) > 1:
        raise ValueError("only one heavy chain is allowed for each cell")
    if told[0] == 0 and told[2]:
        raise ValueError("light chains without a heavy chain")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(c).cast("string").alias("x")))), lambda s: s["x"]), ";").alias(c)
    calls = [v_call, j_call, *([junc_len] if junc_len else [])]
    heavy = df.filter(is_in(locus, HEAVY) & F.col(v_call).isNotNull() & F.col(j_call).isNotNull())
    return heavy.groupBy(F.col(cell_id).alias("_cell")).agg(F.min("_at").alias("_first"), *[joined(c) for c in calls])


def group_genes(df: DataFrame, v_call: str = "v_call", j_call: str = "j_call", junc_len: str | None = None, first: bool = False, key: str = "sequence_id", cell_id: str | None = None, locus: str = "locus") -> DataFrame:
    """key, v_group, group_key: classes of rows linked by a common V and J gene (and length); v_group is G1, G2, ... by least key.

    Without cell_id rows without a call drop out. With it, a cell has the calls of its heavy
    chains and gives its group to its light chains; rows without a cell are one cell, whose
    light chains, like cells without a heavy chain, have no group. Only distinct sets of
    tokens are linked. Groups are at most as many as pairs of genes, whatever the rows, so their
    numbers come from one window.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    calls = [v_call, j_call, *([junc_len] if junc_len else [])]
    if cell_id is None:
        rows = df.select(F.col(key).alias("_at"), *calls)
    else:
        rows = _cells(df.withColumn("_at", F.col(key)), v_call, j_call, junc_len, cell_id, locus).withColumnRenamed("_first", "_at")
    for c in calls:
        rows = rows.filter(told(c))
    tokens = F.array_join(vj_tokens(v_call, j_call, junc_len, first), "|")
    rows = rows.select("_at", *(["_cell"] if cell_id else []), tokens.alias("tokens"))
    sets = rows.groupBy("tokens").agg(F.min("_at").alias("least"))
    links = sets.select(F.concat(F.lit("set "), "tokens").alias("u"), F.explode(F.split("tokens", r"\|")).alias("v"))
    comp = components(links).filter("node like 'set %'").select(F.expr("substring(node, 5)").alias("tokens"), "comp")
    least = sets.join(comp, "tokens").withColumn("group_key", F.min("least").over(Window.partitionBy("comp"))).select("tokens", "group_key")
    names = least.select("group_key").distinct().withColumn("v_group", F.concat(F.lit("G"), F.row_number().over(Window.orderBy("group_key"))))
    found = rows.join(least.join(names, "group_key"), "tokens")
    if cell_id is None:
        return found.select(F.col("_at").alias(key), "v_group", "group_key")
    is_heavy = F.coalesce(F.col(locus).isin(*HEAVY), F.lit(False))
    out = df.join(found.select("_cell", "v_group", "group_key"), F.col(cell_id).eqNullSafe(F.col("_cell")), "left")
    chain = F.col(locus).isin(*HEAVY, *LIGHT) & (F.col(cell_id).isNotNull() | is_heavy)
    return out.select(key, *[F.when(chain, F.col(c)).alias(c) for c in ("v_group", "group_key")])
