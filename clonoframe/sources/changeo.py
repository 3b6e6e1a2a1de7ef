"""Change-O tables: tab-separated text, all columns strings, legacy sequence columns in upper case."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What counts as missing.
MISSING = ("", "NA", "None")


def read(spark: SparkSession, path: str, select: list[str] | None = None, drop: list[str] | None = None, upper: tuple[str, ...] = ("SEQUENCE", "SEQUENCE_VDJ", "SEQUENCE_IMGT", "JUNCTION", "GERMLINE_IMGT", "GERMLINE_IMGT_D_MASK")) -> DataFrame:
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=False, quote='"', escape='"')
    df = df.select(*[c for c in df.columns if (select is None or c in select) and c not in (drop or ())])
    clean = lambda c: F.when(F.col(c).isin(*MISSING), None).otherwise(F.upper(c) if c in upper else F.col(c))
    return df.select(*[clean(c).alias(c) for c in df.columns])


def write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="NA", emptyValue="")
