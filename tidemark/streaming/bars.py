"""Open, high, low, close and volume of events in event-time windows, for batches and for streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_bars(events: DataFrame, size: str = "1 hour", late: str = "2 hours", key: str = "event_type") -> DataFrame:
    """``key``, bar_start, open, high, low, close, volume and n. On a stream, windows close ``late`` after the newest
    event; open and close are the first and last by time, then id."""
    order = F.struct("ts", "event_id")
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    bars = rows.groupBy(key, F.window("ts", size)).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.sum("value").alias("volume"), F.count(F.lit(1)).alias("n")
    )
    return bars.select(key, F.col("window.start").alias("bar_start"), "open", "high", "low", "close", "volume", "n")


def read_events(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def stream_to_table(bars: DataFrame, name: str, checkpoint: str):
    """Appends closed bars to a table, exactly once, and ends when the input does."""
    return bars.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).toTable(name)
