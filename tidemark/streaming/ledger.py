"""Current pointer, change feed and the signal job as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ledger import PAIR, change_feed, current_signal
from tidemark.sources.tables import overwrite_batch


def streaming_current(signals: DataFrame) -> DataFrame:
    """Monotone pointer per (market, horizon), update mode: one small state row per pair."""
    return current_signal(signals)


def batches_of(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batch folders below a path in any store Spark can read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []
    return [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")]


def held_table(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """A table that is versioned by batch, as the newest earlier batch left it; None before the first one."""
    earlier = [b for b in batches_of(spark, path) if b < batch_id]
    return spark.read.parquet(f"{path}/batch={max(earlier)}") if earlier else None


def pointer_upsert(updates: DataFrame, path: str, batch_id: int) -> None:
    """foreachBatch body over `streaming_current` in update mode: changed pairs replace their row where they are newer, the others stay.

    The table is versioned by batch, so a repeated batch gives the same version."""
    held = held_table(updates.sparkSession, path, batch_id)
    overwrite_batch(current_signal(updates if held is None else held.unionByName(updates)), path, batch_id)


def pointer_changes(batch: DataFrame, pointer_path: str, changes_path: str, batch_id: int) -> None:
    """foreachBatch body: move the pointer and write every change of a pair's current signal, in order, also those between two signals of one batch.

    The pointer is versioned by batch, so repeating a batch reads the state before it and writes
    the same result. The state is that of the newest earlier batch, however far back; only the first batch starts without one.
    A signal that is older than the pointer never becomes current and is no change.
    """
    held = held_table(batch.sparkSession, pointer_path, batch_id)
    if batch_id and held is None:
        raise RuntimeError(f"{pointer_path} holds no pointer before batch {batch_id}")
    order = F.struct("cutoff_at", "sequence", "issued_at")
    fresh = batch
    if held is not None:
        at = held.select(*PAIR, F.col("signal_id").alias("_held"), order.alias("_at"))
        fresh = batch.join(at, PAIR, "left").where(F.col("_at").isNull() | (order > F.col("_at"))).drop("_at")
    changed = change_feed(fresh)
    if held is not None:
        changed = changed.withColumn("previous_id", F.coalesce("previous_id", "_held")).where(
            F.col("previous_id").isNull() | (F.col("previous_id") != F.col("signal_id"))).drop("_held")
    overwrite_batch(changed, changes_path, batch_id)
    newest = current_signal(batch)
    overwrite_batch(newest if held is None else current_signal(held.unionByName(newest)), pointer_path, batch_id)


def signal_job(build: Callable[[DataFrame], dict[str, DataFrame]], root: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch body that runs the batch plan on the decisions of closed bars.

    `build` maps a batch of decisions to {"snapshots": …, "signals": …, "events": …}. Each table
    is written to a folder of the batch id, so a repeated batch replaces what it wrote before.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        for name, df in build(batch).items():
            overwrite_batch(df, f"{root}/{name}", batch_id, name)
    return run
