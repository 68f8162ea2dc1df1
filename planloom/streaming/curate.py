"""Streaming forms of corpus operators, on Structured Streaming (an extension: the batch forms are the reference)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.operators.curate import key_of


def stream_parquet(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def keep_first(stream: DataFrame, keys: list, event_time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; state older than the delay is dropped."""
    return stream.withColumn("_key", key_of(*keys)).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def windowed_counts(stream: DataFrame, event_time: str, by: list[str], width: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and columns; late rows within the delay count."""
    window = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    return stream.withWatermark(event_time, delay).groupBy(window.alias("window"), *by).agg(F.count(F.lit(1)).alias("n"))


def reject_matching(stream: DataFrame, frozen: DataFrame, keys: list) -> DataFrame:
    """Rows of the stream whose key is not in a static frozen set."""
    seen = frozen.select(key_of(*keys).alias("_seen")).distinct().withColumn("_hit", F.lit(True))
    return stream.withColumn("_key", key_of(*keys)).join(seen, F.col("_key") == F.col("_seen"), "left").where(F.col("_hit").isNull()).drop("_key", "_seen", "_hit")
