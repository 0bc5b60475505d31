"""Sessions over a stream of events, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def streaming_sessions(events: DataFrame, key: Column, at: Column, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Open-ended session windows per key: start, end and events. ``at`` is a timestamp; null keys and times are left out.

    An event exactly ``gap`` after the last one joins its session. The end is the last event's time, not the window's.
    """
    rows = events.select(key.alias("key"), at.alias("at")).filter("key is not null and at is not null").withWatermark("at", late)
    g = rows.groupBy("key", F.session_window("at", gap)).agg(F.min("at").alias("session_start"), F.max("at").alias("session_end"), F.count(F.lit(1)).alias("events"))
    return g.select("key", "session_start", "session_end", "events")


def write_sessions(sessions: DataFrame, path: str, checkpoint: str):
    """Append closed sessions to Parquet; restarts go on from the checkpoint."""
    return sessions.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
