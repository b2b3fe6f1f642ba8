"""Streaming extension, beyond the batch engine's scope: counts by window of an event stream with late data."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Number of events per window and key; state is dropped once the watermark passes a window's end."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("window_start"), key, "events")
