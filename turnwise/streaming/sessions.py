"""Live sessions over an append-only folder of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_sessions(turns: DataFrame, gap: str = "60 minutes", late: str = "2 hours") -> DataFrame:
    """source, session_start, session_end, turns: sessions close when the watermark passes them."""
    s = turns.withWatermark("ts", late).groupBy("source", F.session_window("ts", gap)).agg(F.count("*").alias("turns"))
    return s.select("source", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "turns")


def live_activity(turns: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Turns and characters by source and tumbling window."""
    s = turns.withWatermark("ts", late).groupBy("source", F.window("ts", width)).agg(F.count("*").alias("turns"), F.sum(F.length("content")).alias("chars"))
    return s.select("source", F.col("window.start").alias("start"), "turns", "chars")
