"""Beyond parity: windowed step statistics over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, ts: str = "ts", value: str = "value", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and mean by event type and window; works on a stream (with a watermark) and on a table."""
    stamped = events.withColumn("at", F.col(ts).cast("timestamp"))
    if stamped.isStreaming:
        stamped = stamped.withWatermark("at", late)
    return stamped.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean")
