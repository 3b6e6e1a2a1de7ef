"""FASTQ records, and their qualities joined to annotated sequences."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.base_quality import alignment_quality


def read_fastq(spark: SparkSession, path: str, offset: int = -33) -> DataFrame:
    """sequence_id, sequence, quality (array of int) of each record; blank lines are passed over.

    Files are read in splits. The lines of a file are numbered from the lines of the splits before;
    four by four they are a record, whichever split they came from. A record that
    is cut short, or whose lines aren't as they should be, is an error.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    lines = lines.filter(F.trim("value") != "")
    lines = lines.withColumn("k", F.row_number().over(Window.partitionBy("f", "b").orderBy("i")) - 1)
    ahead = lines.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"))
    ahead = ahead.select("f", "b", F.coalesce(F.sum("n").over(Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = F.col("before") + F.col("k")
    part = lambda j: F.max(F.when(at % 4 == j, F.col("value")))
    r = lines.join(ahead, ["f", "b"]).groupBy("f", F.floor(at / 4).alias("r")).agg(*[part(j).alias(f"l{j}") for j in range(4)])
    ok = F.col("l0").startswith("@") & F.col("l2").startswith("+") & (F.char_length("l1") == F.char_length("l3"))
    name = F.when(F.coalesce(ok, F.lit(False)), F.expr("substring(l0, 2)")).otherwise(F.raise_error(F.concat(F.lit("malformed FASTQ record at "), F.coalesce("l0", F.lit("?")))))
    return r.select(name.alias("sequence_id"), F.col("l1").alias("sequence"), F.transform(F.split("l3", ""), lambda c: F.ascii(c) + offset).alias("quality"))


def read_fastq_db(df: DataFrame, path: str, offset: int = -33, header: str = "presto", key: str = "sequence_id", style: str = "num", quality_sequence: bool = False, **columns) -> DataFrame:
    """df with the qualities of its reads on alignment coordinates (quality_alignment_num, quality_alignment).

    header `presto`: a read's id ends at its first |. Rows without a read get nulls.
    """
    if header not in ("presto", "asis"):
        raise ValueError("header must be presto or asis")
    reads = read_fastq(df.sparkSession, path, offset)
    name = F.regexp_replace("sequence_id", r"\|.+", "") if header == "presto" else F.col("sequence_id")
    reads = reads.select(name.alias("_id"), F.array_join(F.transform("quality", lambda q: q.cast("string")), ",").alias("quality_num"), F.array_join(F.transform("quality", lambda q: F.char(q - offset)), "").alias("quality"))
    out = alignment_quality(df.join(reads, F.col(key).cast("string") == F.col("_id"), "left").drop("_id"), style=style, **columns)
    return out if quality_sequence else out.drop("quality", "quality_num")
