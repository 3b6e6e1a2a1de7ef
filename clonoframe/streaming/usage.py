"""Gene usage over a stream: counts by event-time window and gene, late rows beyond the watermark left out."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.genes import get_gene


def windowed_usage(stream: DataFrame, time: str, gene: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    kept = stream.filter(F.col(gene).isNotNull()).withWatermark(time, late)
    return kept.groupBy(F.window(time, window).alias("window"), get_gene(F.col(gene)).alias("gene")).agg(F.count(F.lit(1)).alias("seq_count"))
