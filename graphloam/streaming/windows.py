"""Event-time windows over event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, every: str = "1 hour", late: str = "10 minutes", time_column: str = "ts") -> DataFrame:
    """(start, event_type, n, total) of each window; for streams the state is bounded by the watermark."""
    typed = events.withColumn("at", F.col(time_column).cast("timestamp"))
    typed = typed.withWatermark("at", late) if events.isStreaming else typed
    return typed.groupBy(F.window("at", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time_column: str = "ts") -> DataFrame:
    """(user_id, start, end, n) of runs of a user's events with gaps below `gap`."""
    typed = events.withColumn("at", F.col(time_column).cast("timestamp"))
    typed = typed.withWatermark("at", late) if events.isStreaming else typed
    out = typed.groupBy("user_id", F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
