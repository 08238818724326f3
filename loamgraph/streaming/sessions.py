"""Keyed sessions over an event stream: gaps end a session, late events within the watermark still join it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "2 seconds") -> DataFrame:
    """user_id, session_start, n, total: works on a static and on a streaming DataFrame with ts, user_id, value."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null")
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    per = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return per.select("user_id", F.col("w.start").alias("session_start"), "n", "total")
