"""An extension, as the batch operators have no streams: windowed class totals and a merge that keeps the surest value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files that arrive in a folder, as a stream."""
    return spark.readStream.schema(EVENTS).parquet(folder)


def class_totals(events: DataFrame, window: str = "1 day", lateness: str = "2 hours") -> DataFrame:
    """Count and sum per window and class; rows later than ``lateness`` behind the newest are dropped."""
    timed = events.withWatermark("ts", lateness).groupBy(F.window("ts", window), F.col("event_type").alias("kind"))
    return timed.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "kind", "n", "total")


def surest_values(predictions: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Per window and cell the value farthest from one half: the certainty merge over a stream."""
    timed = predictions.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "cell")
    return timed.agg(F.max_by("value", F.abs(F.col("value") - 0.5)).alias("value")).select(F.col("window.start").alias("start"), "cell", "value")
