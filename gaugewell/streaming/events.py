"""Telemetry summaries over a stream of events: the batch aggregate with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import outside, within


def windowed(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events, their mean valid value and outliers by window and type; rows later than ``late`` are left out.
    Works on a stream and on a table alike."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.avg(within(F.col("value"))), 4).alias("mean_value"), F.count_if(outside(F.col("value"))).alias("outliers")).select(F.col("w.start").alias("window_start"), "event_type", "events", "mean_value", "outliers")
