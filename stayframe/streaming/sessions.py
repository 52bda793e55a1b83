"""Sessions of an event stream: the streaming form of merging events that lie close together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_stream(events: DataFrame, key: str, time: str, value: str, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Per key and session (events less than `gap` apart): start, end, events, and the largest value. Events later than
    `late` behind the stream are dropped; a session is emitted when the watermark has passed its end."""
    timed = events.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", late)
    window = F.session_window("__at", gap)
    grouped = timed.groupBy(key, window.alias("session")).agg(F.count(F.lit(1)).alias("events"), F.max(value).alias("highest"))
    return grouped.select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "events", "highest")
