"""Event-time windows and duplicates; the same functions serve a stream and a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "1 hour"


def _watermarked(events: DataFrame, time: str, late: str) -> DataFrame:
    return events.withWatermark(time, late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str, time: str = "ts", by: str = "event_type", value: str = "value", late: str = LATE, slide: str | None = None) -> DataFrame:
    """Count and sum by key and window; windows overlap where ``slide`` is shorter than ``width``."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    grouped = _watermarked(events, time, late).groupBy(window.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str, time: str = "ts", by: str = "user_id", late: str = LATE) -> DataFrame:
    """Runs of a key's events that are less than ``gap`` apart."""
    grouped = _watermarked(events, time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), by, "n")


def once(events: DataFrame, key: list[str], time: str = "ts", late: str = LATE) -> DataFrame:
    """Each key's first copy to arrive; a stream forgets keys that are older than the watermark."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)
    return events.dropDuplicates(key)
