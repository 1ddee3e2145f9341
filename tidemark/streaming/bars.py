"""Streaming bars: the batch aggregates under a two-second watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.constants import BAR_DELAY_S
from tidemark.operators.bars import bar_aggregates


def streaming_bars(trades: DataFrame, width_s: int = 60, delay_s: int = BAR_DELAY_S) -> DataFrame:
    """Closed bars of a trade stream, in append mode.

    A bar leaves when the watermark reaches close + delay; later trades of that bar are dropped.
    `event_time` must be a zoned timestamp (cast naive columns first).
    """
    w = F.window("event_time", f"{width_s} seconds")
    return (trades.withWatermark("event_time", f"{delay_s} seconds")
            .groupBy("market_id", w.alias("w")).agg(*bar_aggregates())
            .select("market_id", "open_usd", "high_usd", "low_usd", "close_usd", "volume", "trade_count", "vwap_usd",
                    F.col("w.start").alias("bar_start_at"), F.col("w.end").alias("bar_close_at")))


def first_seen(events: DataFrame, key: str = "dedupe_key", clock: str = "occurred_at",
               within: str = "1 hour") -> DataFrame:
    """Each message key once; the state of a key is kept for the watermark span only."""
    return events.withWatermark(clock, within).dropDuplicatesWithinWatermark([key])
