"""Trades to bars, window scans, row checks and the bar as-of join."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.constants import BAR_DELAY_S, LOOKBACK_DAYS
from tidemark.functions.timing import bucket_start, plus_seconds, time_bucket
from tidemark.operators.asof import Probe, asof_many


def trades_window(trades: DataFrame, market_id: str, start: str | datetime, end: str | datetime) -> DataFrame:
    """Trades of one market in [start, end]; the filter reaches the scan."""
    return trades.where((F.col("market_id") == market_id)
                        & F.col("event_time").between(F.lit(start).cast("timestamp"),
                                                      F.lit(end).cast("timestamp")))


def latest_trade(trades: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("trade_id", "price_usd", "size", "side", "event_time"),
                      F.struct("event_time", "trade_id"))
    return trades.groupBy("market_id").agg(newest.alias("t")).select("market_id", "t.*")


def bar_aggregates() -> list:
    """The OHLCV aggregate list, shared by the batch and the streaming job."""
    order = F.struct("event_time", "trade_id")
    volume = F.sum("size")
    close = F.max_by("price_usd", order)
    return [
        F.min_by("price_usd", order).alias("open_usd"),
        F.max("price_usd").alias("high_usd"),
        F.min("price_usd").alias("low_usd"),
        close.alias("close_usd"),
        volume.alias("volume"),
        F.count(F.lit(1)).alias("trade_count"),
        F.when(volume > 0, F.sum(F.col("price_usd") * F.col("size")) / volume)
        .otherwise(close).alias("vwap_usd"),
    ]


def ohlcv(trades: DataFrame, width_s: int = 60) -> DataFrame:
    """One bar per (market, interval) that has trades. Ties in time break by trade id.

    Every aggregate combines map-side, so a busy market costs one partial row per task.
    """
    return (trades.groupBy("market_id", time_bucket("event_time", width_s).alias("_slot"))
            .agg(*bar_aggregates())
            .withColumn("bar_start_at", bucket_start("_slot", width_s))
            .withColumn("bar_close_at", plus_seconds("bar_start_at", width_s))
            .drop("_slot"))


def bars_window(bars: DataFrame, market_id: str, start, end) -> DataFrame:
    return bars.where((F.col("market_id") == market_id)
                      & F.col("bar_close_at").between(F.lit(start).cast("timestamp"),
                                                      F.lit(end).cast("timestamp")))


def trade_problems() -> dict:
    return {"price_not_positive": F.col("price_usd") <= 0, "size_not_positive": F.col("size") <= 0}


def bar_problems() -> dict:
    """Named violations of the bar contract."""
    lowest = F.least("open_usd", "high_usd", "low_usd", "close_usd")
    return {
        "clock": F.col("bar_start_at") >= F.col("bar_close_at"),
        "price_not_positive": lowest <= 0,
        "high_too_low": F.col("high_usd") < F.greatest("open_usd", "close_usd"),
        "low_too_high": F.col("low_usd") > F.least("open_usd", "close_usd"),
        "negative_volume": F.col("volume") < 0,
    }


def with_availability(bars: DataFrame) -> DataFrame:
    return bars.withColumn("bar_available_at", plus_seconds("bar_close_at", BAR_DELAY_S))


def asof_bar(decisions: DataFrame, bars: DataFrame, payload: list[str], earlier: DataFrame | None = None) -> DataFrame:
    """Last bar usable at each cutoff: closed two seconds before it and inside the look-back.

    Bars must carry `idx`, their position in the market. `bars_in_lookback` counts the usable
    bars of the look-back window; bars that close before its start are subtracted. `earlier` names the bars (market_id, bar_close_at, idx)
    that may close before it, where `bars` holds the newest ones only.
    """
    b = with_availability(bars)
    names = list(dict.fromkeys(["bar_close_at", "idx", *payload]))
    first = F.col("cutoff_at") - F.expr(f"INTERVAL {LOOKBACK_DAYS} DAYS")
    # a bar closes before the look-back if it was available before the look-back plus the delay, so one series serves both look-ups
    d = decisions.withColumn("_from", first).withColumn("_known", plus_seconds("_from", BAR_DELAY_S))
    probes = {"_bar": Probe("cutoff_at"), "_old": Probe("_known", strict=True)}
    if earlier is not None:
        b0 = with_availability(earlier).select("market_id", "bar_available_at", "idx")
        d = asof_many(d, b0, ["market_id"], {"_old": probes.pop("_old")}, "bar_available_at", ["idx"], bucket_s=86400)
    d = asof_many(d, b.select("market_id", "bar_available_at", *names), ["market_id"], probes, "bar_available_at", names, bucket_s=86400)
    d = d.select(*decisions.columns, "_from", F.col("_old.idx").alias("_idx0"), *[F.col(f"_bar.{n}").alias(n) for n in names])
    inside = F.col("bar_close_at") >= F.col("_from")
    return (d.withColumn("bars_in_lookback",
                         F.when(inside, F.col("idx") - F.coalesce("_idx0", F.lit(0)))
                         .otherwise(F.lit(0)).cast("bigint"))
            .select(*decisions.columns, "bars_in_lookback",
                    *[F.when(inside, F.col(n)).alias(n) for n in names if n != "idx"]))
