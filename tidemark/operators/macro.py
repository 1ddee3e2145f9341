"""Macro series: changes between releases, yield slope, availability intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import bps_change, pct_change


def with_changes(obs: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Month and year percent change by row offset 1 and 12 inside one series vintage.

    Offsets are taken before unusable values are dropped, so an unusable neighbour gives NULL.
    A vintage holds one row per reference period (12 a year), so its window stays small.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return (obs
            .withColumn("mom_pct", pct_change(F.col("value"), F.lag("value", 1).over(w)))
            .withColumn("yoy_pct", pct_change(F.col("value"), F.lag("value", 12).over(w)))
            .where(F.col("value").isNotNull()))


def latest_vintage(obs: DataFrame) -> DataFrame:
    """Newest revision of every (series, reference period)."""
    pick = F.max_by(F.struct("value", "available_at", "record_id"),
                    F.struct("revision_seq", "available_at", "record_id"))
    return (obs.groupBy("series_id", "reference_period").agg(pick.alias("r"))
            .select("series_id", "reference_period", "r.*"))


def rate_changes(obs: DataFrame, series: tuple[str, ...]) -> DataFrame:
    """Basis-point change against the previous period of the same rate series."""
    w = Window.partitionBy("series_id").orderBy("reference_period")
    return (latest_vintage(obs.where(F.col("series_id").isin(*series)))
            .withColumn("change_bps", bps_change(F.col("value"), F.lag("value").over(w))))


def yield_slope(obs: DataFrame) -> DataFrame:
    """Ten-year minus two-year yield in basis points per reference period."""
    wide = (latest_vintage(obs.where(F.col("series_id").isin("US_UST_2Y", "US_UST_10Y")))
            .groupBy("reference_period")
            .pivot("series_id", ["US_UST_2Y", "US_UST_10Y"]).agg(F.first("value")))
    return wide.select("reference_period",
                       bps_change(F.col("US_UST_10Y"), F.col("US_UST_2Y")).alias("slope_bps"))
