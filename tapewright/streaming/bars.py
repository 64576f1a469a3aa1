"""Bars from a stream of ticks, with late ticks up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, interval: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Tumbling bars of a streaming frame with symbol, ts (timestamp), tick_id, price
    and volume. In append mode a bar comes out once no tick can change it any more."""
    order = F.struct("ts", "tick_id")
    bars = ticks.withWatermark("ts", lateness).groupBy("symbol", F.window("ts", interval)).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume")
    )
    return bars.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")
