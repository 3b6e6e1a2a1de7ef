"""What the pipeline's stages need besides the operators: filtering whole documents by small tables of keys.

The documents' columns are renamed by place inside, so they may have any names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BITS, Scratch, bitmap, held, trim


def _placed(docs: DataFrame, key: str) -> DataFrame:
    """docs with columns c0, c1, ..., and key (long)."""
    return docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col(f"`{key}`").cast("long").alias("key"))


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _split(rows: DataFrame, bits) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is certainly not in the bitmap, and the others."""
    schema = rows.schema
    at = len(schema)

    def pick(inside: bool):
        def run(batches):
            for b in batches:
                hit = held(bits.value, b.column(at).to_numpy())
                yield pa.RecordBatch.from_arrays(b.filter(pa.array(hit == inside)).columns[:at], names=schema.names)
            trim()

        cell = F.coalesce(F.pmod(F.xxhash64("key"), F.lit(BITS)).cast("long"), F.lit(0))
        return rows.withColumn("cell", cell).mapInArrow(run, schema)

    return pick(False), pick(True)


def without(docs: DataFrame, losers: DataFrame, scratch: Scratch, key: str = "doc_id", once: DataFrame | None = None) -> DataFrame:
    """The documents whose key is not in losers; of those with a key in `once`, one row each.

    Only rows that a fixed-size bitmap of these keys can't clear are shuffled. Rows with a
    null key stay.
    """
    acts = losers.select(F.col(losers.columns[0]).cast("long").alias("k"), F.lit(True).alias("drop"))
    if once is not None:
        acts = acts.union(once.select(F.col(once.columns[0]).cast("long"), F.lit(False)))
    acts = scratch.write(acts.filter("k is not null").groupBy("k").agg(F.max("drop").alias("drop")), "acts")
    clear, rest = _split(_placed(docs, key), docs.sparkSession.sparkContext.broadcast(bitmap(acts.select("k"))))
    rest = rest.join(acts, F.col("key") == F.col("k"), "left")
    kept = clear.unionByName(rest.filter("k is null").select(*clear.columns))
    if once is not None:
        kept = kept.unionByName(rest.filter("k is not null and not drop").select(*clear.columns).dropDuplicates(["key"]))
    return _named(kept, docs)


def one_of_each(docs: DataFrame, classes: DataFrame, scratch: Scratch, key: str = "doc_id") -> DataFrame:
    """classes (key, component_id): the document with the component's least key stays, in one row."""
    classes = scratch.write(classes.select(F.col(key).alias("k"), "component_id"), "classes")
    losers = classes.filter("k <> component_id").select("k").distinct()
    once = classes.filter("k = component_id").groupBy("k").count().filter("count > 1").select("k")
    return without(docs, losers, scratch, key, once)


def repeated(docs: DataFrame, mixed: DataFrame, scratch: Scratch, key: str = "doc_id") -> DataFrame:
    """Each document as often as mixed (key, copies) says; rows of one key share the largest number."""
    mixed = scratch.write(mixed.groupBy(F.col(key).cast("long").alias("k")).agg(F.max("copies").cast("int").alias("n")).filter("n > 0"), "copies")
    rows = _placed(docs, key).join(mixed, F.col("key").eqNullSafe(F.col("k")))
    return _named(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))), docs)
