"""Sessions by gap: a new one starts where more than ``gap_minutes`` passed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessionise(events: DataFrame, key: list[str], ts: str, tie: list[str], gap_minutes: int = 60) -> DataFrame:
    """Adds ``session``, counted from 0 for each key in time order; a gap of just the limit stays within."""
    w = Window.partitionBy(*key).orderBy(ts, *tie)
    new = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp")) > gap_minutes * 60_000_000).cast("int")
    return events.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
