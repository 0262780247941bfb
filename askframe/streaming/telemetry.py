"""Telemetry as a stream: hits by key in windows of event time, with late events dropped after the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_hits(events: DataFrame, time: str, key: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of ``key`` in tumbling windows, for a stream or a batch."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    counts = timed.groupBy(F.window("_t", window).alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("hits"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "hits")
