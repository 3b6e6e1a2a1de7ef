"""The corpus pipeline: quality, near duplicates, decontamination, mixing, shards.

Every stage works on all documents that the one before kept, takes and returns the columns
of documents (the last returns the shards), and runs one corpus operator. run() writes each
stage's result to the shared folder and reads it again, so a lost executor never costs more
than the running stage. Null and empty texts are rejected by the first stage; an empty table
passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoframe.llm.common import Scratch, table
from clonoframe.llm.decontaminate import decontaminate
from clonoframe.llm.jaccard import near_duplicates
from clonoframe.llm.kneser_ney import keep_good
from clonoframe.llm.mixing import mix_sources
from clonoframe.llm.sharding import kd_shards
from clonoframe.llm.stages import one_of_each, repeated, without


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of trusted text accepts."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least id."""
    return one_of_each(docs, near_duplicates(docs), Scratch(spark, "dedup"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    hit = decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id")
    scratch = Scratch(spark, "leaks")
    return without(docs, scratch.write(hit, "hit"), scratch)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return repeated(docs, mix_sources(docs).select("doc_id", "copies"), Scratch(spark, "copies"))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document of the mix."""
    return kd_shards(docs, shards=8).withColumn("grown_shard", F.col("grown_shard").cast("int"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicate), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The language model's and the components' rows have no plain SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; returns the last stage's rows."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs, name)
    return docs
