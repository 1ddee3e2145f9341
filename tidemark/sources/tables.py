"""Storage layout: partition columns, append sinks, pruned scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# table → (time column, partition unit)
LAYOUT = {
    "trades": ("event_time", "day"),
    "quotes": ("observed_at", "day"),
    "bars": ("bar_close_at", "month"),
    "snapshots": ("cutoff_at", "month"),
    "signals": ("issued_at", "month"),
}


def with_partition(df: DataFrame, table: str) -> DataFrame:
    """Add the UTC partition date of the table's layout."""
    column, unit = LAYOUT[table]
    return df.withColumn("part", F.date_trunc(unit, column).cast("date"))


def append(df: DataFrame, table: str, path: str, sort: list[str] | None = None) -> None:
    """Append to the partitioned Parquet table.

    Rows of a partition spread over several writers by a hash of the sort key, so one busy
    day does not land in a single task; files are sorted for row-group pruning.
    """
    d = with_partition(df, table)
    if sort:
        d = d.repartition("part", *sort[:1]).sortWithinPartitions("part", *sort)
    d.write.mode("append").partitionBy("part").parquet(path)


def overwrite_batch(df: DataFrame, path: str, batch_id: int, table: str | None = None) -> None:
    """Idempotent write of one streaming batch: a rerun replaces its own folder only. With the name of a table of LAYOUT
    its partition folders lie inside, so that `scan` reads streams and appends alike."""
    target = f"{path}/batch={batch_id}"
    if table in LAYOUT:
        with_partition(df, table).write.mode("overwrite").partitionBy("part").parquet(target)
    else:
        df.write.mode("overwrite").parquet(target)


def scan(spark: SparkSession, table: str, path: str, start=None, end=None) -> DataFrame:
    """Rows with start ≤ time ≤ end. The partition filter prunes folders, the time filter row groups."""
    column, unit = LAYOUT[table]
    d = spark.read.parquet(path)
    if start is not None:
        lo = F.lit(start).cast("timestamp")
        d = d.where((F.col("part") >= F.date_trunc(unit, lo).cast("date")) & (F.col(column) >= lo))
    if end is not None:
        hi = F.lit(end).cast("timestamp")
        d = d.where((F.col("part") <= F.date_trunc(unit, hi).cast("date")) & (F.col(column) <= hi))
    return d.drop("part", "batch")


def event_envelope(bars: DataFrame, source: str = "market-collector") -> DataFrame:
    """Bar-closed events: key, clock and JSON payload with its size check."""
    from tidemark.functions.checks import event_too_large
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"
    payload = F.to_json(F.struct(
        "market_id", F.date_format("bar_start_at", iso).alias("open_time"),
        F.date_format("bar_close_at", iso).alias("close_time"),
        F.date_format(F.col("bar_close_at") + F.expr("INTERVAL 2 SECONDS"), iso).alias("available_at"),
        "close_usd", "volume", "vwap_usd"))
    d = bars.select(
        F.concat_ws("-", "market_id", F.date_format("bar_close_at", iso)).alias("dedupe_key"),
        F.concat_ws(".", F.lit("raw.market.v1"), "market_id").alias("subject"),
        F.col("bar_close_at").alias("occurred_at"), F.lit(source).alias("source"),
        payload.alias("payload"), F.lit(False).alias("is_replay"))
    return d.withColumn("too_large", event_too_large(F.col("payload")))
