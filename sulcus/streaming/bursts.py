"""Micro-batch forms of window sums and bursts (an extension: the batch operators need no stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_power(events: DataFrame, size: str = "1 hour", slide: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """events: ts, channel, value.  Mean square per sliding window and channel; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "channel").agg(F.avg(F.col("value") * F.col("value")).alias("power"), F.count(F.lit(1)).alias("n"))


def bursts(events: DataFrame, level: float, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of values above a level that are at most `gap` apart."""
    above = events.where(F.abs("value") > level).withWatermark("ts", late)
    return above.groupBy(F.session_window("ts", gap), "channel").agg(F.max(F.abs("value")).alias("peak"), F.count(F.lit(1)).alias("n"))
