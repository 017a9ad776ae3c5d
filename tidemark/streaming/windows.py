"""Page views as a stream: hourly totals that late data corrects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bundles import CHUNK, enrich, flatten


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Enriched bundles of JSON chunks as their files arrive."""
    chunks = spark.readStream.schema(CHUNK).option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return enrich(flatten(chunks))


def hourly(bundles: DataFrame, series: dict[str, Column], lateness: str | None = None) -> DataFrame:
    """Count and sums per hour. Without lateness (complete mode) late data is always counted; with it, state is dropped after it."""
    rows = bundles.select(F.to_timestamp("time").alias("ts"), *[v.cast("double").alias(k) for k, v in series.items()])
    if lateness:
        rows = rows.withWatermark("ts", lateness)
    sums = [F.sum(k).alias(k) for k in series]
    return rows.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("bundles"), *sums).select(F.col("w.start").alias("hour"), "bundles", *series)
