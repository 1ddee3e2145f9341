"""Fund-flow tables: reconciliation of constituents with the reported total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timing import plus_seconds


def cell_number(c: str) -> Column:
    """Thousands commas removed; anything that is no number gives NULL."""
    return F.expr(f"try_cast(translate(trim({c}), ',', '') AS DOUBLE)")


def reconcile(cells: DataFrame, lag_s: int = 3 * 3600) -> DataFrame:
    """One flow row per (asset, session) from cells(asset_id, session_date, fund_id, value_text,
    total_text). Sums combine map-side.

    Without a total, or with an unreadable cell, the day is PARTIAL and carries the sum. Within
    0.2 million it is RECONCILED, otherwise DISPUTED; both carry the reported total. A cell a
    short row lacks has a NULL text: it lowers the coverage but is not unreadable.
    """
    v, t = cell_number("value_text"), cell_number("total_text")
    days = cells.groupBy("asset_id", "session_date").agg(
        F.coalesce(F.sum(v), F.lit(0.0)).alias("_sum"),
        F.count(v).alias("covered_funds"),
        F.count(F.lit(1)).alias("expected_funds"),
        F.coalesce(F.bool_or(F.col("value_text").isNotNull() & v.isNull()), F.lit(False)).alias("_unread"),
        F.max(t).alias("_total"))
    partial = F.col("_total").isNull() | F.col("_unread")
    close = F.abs(F.col("_sum") - F.col("_total")) < 0.2
    million = F.lit(1e6)
    return (days
            .withColumn("status", F.when(partial, "PARTIAL").when(close & ~F.isnan("_sum"), "RECONCILED")
                        .otherwise("DISPUTED"))
            .withColumn("flow_usd", F.when(partial, F.col("_sum")).otherwise(F.col("_total")) * million)
            .withColumn("coverage_ratio", F.col("covered_funds") / F.col("expected_funds"))
            .withColumn("is_complete", F.col("status").isin("SOURCE_COMPLETE", "RECONCILED"))
            .withColumn("event_at", F.col("session_date").cast("timestamp") + F.expr("INTERVAL 21 HOURS"))
            .withColumn("available_at", plus_seconds("event_at", lag_s))
            .withColumn("revision_seq", F.lit(0))
            .withColumn("record_id", F.concat_ws(":", F.lit("etf"), "asset_id", "session_date"))
            .drop("_sum", "_total", "_unread"))


def flow_problems() -> dict[str, Column]:
    return {"expected_funds": F.col("expected_funds") <= 0,
            "covered_funds": ~F.col("covered_funds").between(0, F.col("expected_funds"))}
