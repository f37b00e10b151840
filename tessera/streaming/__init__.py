"""Streams of events (beyond parity: the engine that this one stands in for has none)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, schema: str = EVENTS, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and value per tumbling window and type; works on streams (with a watermark) and tables alike."""
    events = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = events.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
