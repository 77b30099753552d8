"""Event logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by window and type.  Works on batches and, with a watermark, on
    streams; ts may be a timestamp without zone and is read as UTC."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("ts", late)
    found = stamped.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("window.start").alias("start"), "event_type", "n")
