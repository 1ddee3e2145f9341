"""Streams as queries: tables are replayed through the streaming jobs from files and must give what the batch plans give."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators.etf import reconcile
from tidemark.plans.catalog_news import text_tables
from tidemark.plans.registry import plain, query
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources import testtables as tt
from tidemark.streaming.alerts import AlertJob
from tidemark.streaming.bars import streaming_bars
from tidemark.streaming.ledger import batches_of, pointer_changes, pointer_upsert, streaming_current
from tidemark.streaming.signal_job import Feeds, SignalJob


def replay_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/replay-{uuid.uuid4().hex}"


def replayed(df: DataFrame, clock: str, parts: int, folder: str, attach: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Feed a table to a stream in `parts` portions that follow each other in time.

    Each portion is written by all cores and then read by one run of the stream that goes on from its checkpoint, as after a restart.
    """
    span = df.agg(F.min(F.unix_micros(clock)).alias("lo"), F.max(F.unix_micros(clock)).alias("hi")).first()
    lo, width = span["lo"] or 0, ((span["hi"] or 0) - (span["lo"] or 0)) // parts + 1
    for i in range(parts):
        df.where(F.unix_micros(clock).between(lo + i * width, lo + (i + 1) * width - 1)).write.mode("append").parquet(f"{folder}/in")
        stream = attach(df.sparkSession.readStream.schema(df.schema).parquet(f"{folder}/in"))
        stream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()


def feeds(spark: SparkSession, sf: str) -> Feeds:
    return Feeds(tt.decisions(spark, sf), tt.macro_observations(spark, sf), reconcile(tt.etf_cells(spark, sf)), tt.news_evidence(spark, sf), tt.news_polls(spark, sf),
                 tt.rights_sources(spark), tt.rights_policies(spark), tt.macro_calendar(spark, sf), tt.bundles(spark), text_tables)


def replayed_signal_job(spark: SparkSession, sf: str, parts: int = 3) -> str:
    """Run the signal job over all bars in `parts` micro-batches; the folder of its tables."""
    folder = replay_folder(spark)
    series = B.ohlcv(tt.trades(spark, sf), 60)
    job = SignalJob(feeds(spark, sf), f"{folder}/out")
    replayed(series, "bar_close_at", parts, folder, lambda stream: stream.writeStream.foreachBatch(job))
    last = job.feeds.decisions.agg(F.max("cutoff_at")).first()[0]
    job.finish(spark, last, parts)
    return f"{folder}/out"


@query
def stream_signals(spark, sf):
    """Signals issued bar by bar; equal to the batch query `signals`."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    made = spark.read.parquet(f"{replayed_signal_job(spark, sf)}/signals")
    return plain(made.drop("signal_id", "sequence", "part", "batch"))


@query
def stream_pointer(spark, sf):
    """The current pointer kept by an update-mode stream; equal to the batch query `current_signal`."""
    folder, L = replay_folder(spark), tt.signal_ledger(spark, sf)
    replayed(L, "cutoff_at", 4, folder, lambda stream: streaming_current(stream).writeStream.outputMode("update").foreachBatch(
        lambda batch, i: pointer_upsert(batch, f"{folder}/pointer", i)))
    return plain(spark.read.parquet(f"{folder}/pointer/batch={max(batches_of(spark, f'{folder}/pointer'))}").select(*L.columns))


@query
def stream_change_feed(spark, sf):
    """Every change of the pointer, written batch by batch; equal to the batch query `change_feed`."""
    folder = replay_folder(spark)
    replayed(tt.signal_ledger(spark, sf), "cutoff_at", 4, folder, lambda stream: stream.writeStream.foreachBatch(
        lambda batch, i: pointer_changes(batch, f"{folder}/pointer", f"{folder}/changes", i)))
    return plain(spark.read.parquet(f"{folder}/changes").select("market_id", "horizon", "signal_id", F.coalesce("previous_id", F.lit("")).alias("previous_id")))


@query
def stream_alerts(spark, sf):
    """Alerts sent signal by signal; equal to the batch query `alert_dispatch`."""
    folder = replay_folder(spark)
    job = AlertJob(tt.subscriptions(spark, sf), f"{folder}/out")
    replayed(tt.signal_ledger(spark, sf), "issued_at", 4, folder, lambda stream: stream.writeStream.foreachBatch(job))
    return plain(spark.read.parquet(f"{folder}/out/alerts").drop("batch"))


@query
def stream_bars(spark, sf):
    """Minute bars of a trade stream whose watermark passes every bar; equal to the batch bars."""
    folder, t = replay_folder(spark), tt.trades(spark, sf)
    end = t.agg(F.max("event_time")).first()[0]
    tick = t.limit(1).select("trade_id", F.lit("clock").alias("market_id"), "price_usd", "size", "side", (F.lit(end) + F.expr("INTERVAL 1 HOUR")).alias("event_time"))
    # the last trade of another market lets the watermark pass all bars
    replayed(t.unionByName(tick), "event_time", 4, folder, lambda stream: streaming_bars(stream).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/bars"))
    return plain(spark.read.parquet(f"{folder}/bars").where("market_id <> 'clock'"), 9)
