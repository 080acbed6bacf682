"""Events as they come: counts in windows with late ones allowed for, and the current tag values of objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(df: DataFrame, moment: str, late: str) -> DataFrame:
    """Moments with a zone, as watermarks want them; a watermark on streams only."""
    df = df.withColumn(moment, F.col(moment).cast("timestamp"))
    return df.withWatermark(moment, late) if df.isStreaming else df


def windowed_counts(events: DataFrame, moment: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(start, kind, n, total) per window; works on streams, where late rows count up to the watermark, and on tables."""
    frame = _timed(events, moment, late)
    grouped = frame.groupBy(F.window(moment, width, slide) if slide else F.window(moment, width), kind)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, moment: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user, start, end, n): bursts of events with no longer gap between them."""
    frame = _timed(events, moment, late)
    return frame.groupBy(F.session_window(moment, gap), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def latest_edits(edits: DataFrame, late: str = "1 day") -> DataFrame:
    """(objectid, key, value): the value of the highest edit so far; a stream of it is written in complete or update mode."""
    frame = _timed(edits, "loaded_at", late)
    return frame.groupBy("objectid", "key").agg(F.max(F.struct("edit_no", "value")).alias("e")).select("objectid", "key", "e.value")
