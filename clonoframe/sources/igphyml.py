"""IgPhyML tables: parameter estimates and trees of clones."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import newick

# The parameters in the order in which they are reported.
PARAMETERS = (
    "id", "nseq", "nsite", "lhood", "tree_length",
    *[f"{p}_{e}" for p in ("omega_fwr", "omega_cdr", "kappa", "wrc_2", "gyw_0", "wa_1", "tw_0", "syc_2", "grs_0") for e in ("mle", "lci", "uci")],
)
REPERTOIRE = "REPERTOIRE"


class IgPhyML(NamedTuple):
    """params: a row for each clone and the repertoire; command: how the program was called; trees: clone, from_v, to_v, weight; germlines: clone, name."""

    params: DataFrame
    command: str | None
    trees: DataFrame
    germlines: DataFrame


def from_table(table: DataFrame, id: str | None = None, collapse: bool = False, branches: str = "mutations") -> IgPhyML:
    """table: the columns of the file as strings. branches `mutations`: lengths times NSITE, to one decimal; collapse: inner vertices lose their labels.

    A column is a number if all its values are. A clone with several germline tips (<clone>_GERM) is an error.
    """
    if branches not in ("mutations", "distance"):
        raise ValueError("branches must be mutations or distance")
    clones = table.filter(F.col("CLONE") != REPERTOIRE)
    names = [c for c in table.columns if c != "TREE"]
    bad = table.agg(*[F.count(F.when(F.coalesce(F.col(c), F.lit("")).try_cast("double").isNull(), 1)).alias(c) for c in names]).first()
    params = table.select(*[(F.col(c).cast("double") if not bad[c] else F.col(c)).alias(c.lower()) for c in names])
    params = params.withColumn("id", F.lit(id)) if id is not None else params
    head = table.filter(F.col("CLONE") == REPERTOIRE).select("TREE").first()
    text = F.regexp_replace("TREE", r"\)[^(),:;]+", ")") if collapse else F.col("TREE")
    e = newick.edges(clones.select("CLONE", text.alias("TREE")), "CLONE", "TREE")
    tips = e.join(e.select("CLONE", F.col("from_v").alias("to_v")).distinct(), ["CLONE", "to_v"], "left_anti").filter(F.col("to_v").contains(F.concat(F.col("CLONE"), F.lit("_GERM"))))
    tips = tips.groupBy("CLONE").agg(F.count(F.lit(1)).alias("n"), F.min("to_v").alias("name"))
    one = F.when(F.col("n") == 1, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("more than one germline tip in clone "), F.col("CLONE"))))
    if branches == "mutations":
        size = clones.select("CLONE", F.col("NSITE").cast("double").alias("_n"))
        e = e.join(size, "CLONE").withColumn("weight", F.round(F.col("weight") * F.col("_n"), 1)).drop("_n")
    return IgPhyML(params, head["TREE"] if head else None, e.withColumnRenamed("CLONE", "clone"), tips.select(F.col("CLONE").alias("clone"), one.alias("name")))


def read(spark: SparkSession, path: str, id: str | None = None, collapse: bool = False, branches: str = "mutations") -> IgPhyML:
    return from_table(spark.read.csv(path, sep="\t", header=True, inferSchema=False), id, collapse, branches)


def combine(parts: list[IgPhyML], format: str = "wide") -> DataFrame:
    """The repertoires' rows with the parameters that most of the parts have, in the reported order; long: id, variable, value, position."""
    if format not in ("wide", "long"):
        raise ValueError("format must be wide or long")
    have = [set(p.params.columns) for p in parts]
    count = {c: sum(c in h for h in have) for h in have for c in h}
    kept = [c for c in PARAMETERS if count.get(c) and count[c] == max(count.values())]
    if "id" not in kept:
        raise ValueError("id not given when reading")
    out = None
    for p in parts:
        row = p.params.filter(F.col("clone") == REPERTOIRE).select(*kept)
        out = row if out is None else out.unionByName(row)
    if format == "wide":
        return out
    values = [c for c in kept if c != "id"]
    long = out.select("id", *[F.col(c).cast("double").alias(c) for c in values]).unpivot(["id"], values, "variable", "value")
    place = F.element_at(F.create_map(*[x for i, c in enumerate(values) for x in (F.lit(c), F.lit(i + 1))]), F.col("variable"))
    return long.withColumn("position", place)
