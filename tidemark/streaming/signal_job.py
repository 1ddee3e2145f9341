"""The signal job as a stream: closed bars in; snapshots, signals and events out.

Each micro-batch reads its new bars only. What earlier bars contribute is saved per market: the last bars of the series, the values of all
recurrences at the last bar, and a row per day for look-back counts. A decision slot is due once a bar later than its cutoff was
read (bars arrive in the order of their close; a bar no later than the last one of its market is late and dropped), or when `finish` closes the
stream at a given time.

Every table is written to a folder of the batch number and a batch reads the state of the newest earlier one, so a repeated batch does the
same work on the same state and replaces its own output: nothing is lost or doubled after a failure.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.constants import BAR_DELAY_S, HORIZONS, LOOKBACK_DAYS
from tidemark.functions.timing import plus_seconds, stamp, time_bucket
from tidemark.operators.events import event_blackout
from tidemark.operators.indicators import HALO, MIN_BARS, continued_indicators
from tidemark.operators.news import TEXT_COLUMNS, news_features
from tidemark.operators.sequence import with_row_index
from tidemark.plans.signals import signals
from tidemark.plans.snapshot import dedupe_key, feature_snapshot, feed_rights, snapshot_digest
from tidemark.session import cut_lineage
from tidemark.sources.tables import overwrite_batch, scan
from tidemark.streaming.ledger import held_table

KEY = ["market_id", "horizon", "cutoff_at"]


@dataclass(frozen=True)
class Feeds:
    """The tables that a decision looks up. `texts` gives (classes, similar) of news items."""

    decisions: DataFrame
    macro: DataFrame
    flows: DataFrame
    items: DataFrame
    polls: DataFrame
    sources: DataFrame
    policies: DataFrame
    calendar: DataFrame
    bundles: DataFrame
    texts: Callable[[DataFrame], tuple[DataFrame, DataFrame]]
    technical: tuple[str, ...] = field(default_factory=lambda: tuple(MIN_BARS))


def news_within_reach(items: DataFrame, first: str, last: str) -> DataFrame:
    """Items that decide the news of cutoffs first..last: all revisions, known by then, of every source with an item inside the longest reach."""
    clock = F.coalesce("published_at", "source_observed_at")
    reach = max(h["news_long_s"] for h in HORIZONS.values())
    lo, hi = F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp")
    known = items.where(F.col("available_at") <= hi)
    near = known.where((clock >= plus_seconds(lo, -reach)) & (clock <= hi)).select("asset", "source_key").distinct()
    return known.join(near, ["asset", "source_key"], "left_semi")


def signal_events(signals_: DataFrame, snapshot: DataFrame) -> DataFrame:
    """One committed-signal event per signal: id, dedupe key and JSON payload."""
    keys = snapshot.select(*KEY, dedupe_key(snapshot_digest(snapshot)).alias("dedupe_key"))
    payload = F.to_json(F.struct("signal_id", "sequence", "market_id", "horizon", "status", "label", "confidence",
                                 stamp("issued_at").alias("issued_at"), stamp("expires_at").alias("expires_at")))
    return signals_.join(keys, KEY).select(
        F.sha2(F.concat_ws("|", F.lit("growth.signal.committed.v1"), "dedupe_key"), 256).alias("event_id"),
        F.lit("growth.signal.committed.v1").alias("event_type"), "dedupe_key", payload.alias("payload"), F.col("issued_at").alias("occurred_at"))


class SignalJob:
    """`foreachBatch` body over a stream of closed bars."""

    def __init__(self, feeds: Feeds, root: str):
        self.feeds, self.root = feeds, root

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self._advance(batch, batch_id, None)

    def finish(self, spark: SparkSession, until, batch_id: int) -> None:
        """Issue the slots up to a time at which no more bars are awaited."""
        earlier = self._earlier(spark, "carry", batch_id)
        if earlier is not None:
            self._advance(earlier.limit(0).select("market_id", "bar_start_at", "bar_close_at", "open_usd", "high_usd", "low_usd", "close_usd", "volume"), batch_id, until)

    def _earlier(self, spark: SparkSession, name: str, batch_id: int) -> DataFrame | None:
        return held_table(spark, f"{self.root}/{name}", batch_id)

    def _all_before(self, spark: SparkSession, name: str, batch_id: int) -> DataFrame:
        return spark.read.parquet(f"{self.root}/{name}").where(F.col("batch") <= batch_id)

    def _advance(self, batch: DataFrame, batch_id: int, until) -> None:
        spark, feeds = batch.sparkSession, self.feeds
        base = ["market_id", "bar_start_at", "bar_close_at", "open_usd", "high_usd", "low_usd", "close_usd", "volume"]
        held, clock = self._earlier(spark, "carry", batch_id), self._earlier(spark, "clock", batch_id)
        new = batch.select(*base).dropDuplicates(["market_id", "bar_close_at"])
        if held is not None:
            ends = held.where("_last").select("market_id", F.col("bar_close_at").alias("_end"), F.col("idx").alias("_done"))
            new = new.join(ends, "market_id", "left").where(F.col("_end").isNull() | (F.col("bar_close_at") > F.col("_end")))
        else:
            new = new.withColumn("_done", F.lit(None).cast("bigint"))
        new = with_row_index(new, ["market_id"], [F.col("bar_close_at")], time_bucket("bar_close_at", 86400), "_pos")
        new = cut_lineage(new.select(*base, (F.col("_pos") + F.coalesce("_done", F.lit(0))).alias("idx"), "_pos"))
        series = cut_lineage(continued_indicators(new, held, feeds.technical))
        self._save_bars(series, held, batch_id)

        before = clock.first() if clock is not None else None
        newest = series.agg(F.max("bar_close_at").alias("t")).first()["t"]
        frontier = self._frontier(spark, newest, before)
        sent = before["signals"] if before else 0
        slots = self._due(before, frontier, until)
        if not slots.isEmpty():
            sent += self._decide(spark, slots, series, held, batch_id, sent)
        at = frontier if until is None else until
        overwrite_batch(spark.createDataFrame([(at, sent)], "frontier timestamp, signals bigint"), f"{self.root}/clock", batch_id)

    def _frontier(self, spark: SparkSession, newest, before):
        times = ([newest + timedelta(seconds=BAR_DELAY_S)] if newest else []) + ([before["frontier"]] if before and before["frontier"] else [])
        return max(times) if times else None

    def _due(self, before, frontier, until) -> DataFrame:
        d, cutoff = self.feeds.decisions, F.col("cutoff_at")
        if before and before["frontier"]:
            d = d.where(cutoff >= F.lit(before["frontier"]))
        if until is not None:
            return d.where(cutoff <= F.lit(until))
        return d.where(cutoff < F.lit(frontier)) if frontier else d.limit(0)

    def _save_bars(self, series: DataFrame, held: DataFrame | None, batch_id: int) -> None:
        """The end of every market's series, the numbered bars, and the last bar of every day."""
        top = series.groupBy("market_id").agg(F.max("idx").alias("_top"))
        rows = series.withColumn("_last", F.lit(False))
        if held is not None:
            top = top.unionByName(held.groupBy("market_id").agg(F.max("idx").alias("_top"))).groupBy("market_id").agg(F.max("_top").alias("_top"))
            rows = rows.unionByName(held.withColumn("_last", F.lit(False)), allowMissingColumns=True)
        ends = (rows.join(top, "market_id").where(F.col("idx") > F.col("_top") - (HALO + 1))
                .withColumn("_last", F.col("idx") == F.col("_top")).drop("_top"))
        overwrite_batch(ends, f"{self.root}/carry", batch_id)
        overwrite_batch(series.select("market_id", "bar_close_at", "idx"), f"{self.root}/bars", batch_id, "bars")
        days = series.groupBy("market_id", F.date_trunc("day", "bar_close_at").alias("day")).agg(
            F.max("bar_close_at").alias("bar_close_at"), F.max("idx").alias("idx"))
        overwrite_batch(days, f"{self.root}/days", batch_id)

    def _look_back(self, spark: SparkSession, slots: DataFrame, batch_id: int) -> DataFrame:
        """Bars that may be the last one before a look-back window begins: those of the days asked for, and the last bar of every other day."""
        begins = slots.select((F.col("cutoff_at") - F.expr(f"INTERVAL {LOOKBACK_DAYS} DAYS")).alias("t"))
        span = begins.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
        days = self._all_before(spark, "days", batch_id).groupBy("market_id", "day").agg(F.max("bar_close_at").alias("bar_close_at"), F.max("idx").alias("idx"))
        low, high = (F.date_trunc("day", F.lit(span[k])) for k in ("lo", "hi"))
        whole = days.where(F.col("day") < low).select("market_id", "bar_close_at", "idx")
        inside = scan(spark, "bars", f"{self.root}/bars", start=span["lo"].replace(hour=0, minute=0, second=0, microsecond=0), end=span["hi"])
        return whole.unionByName(inside.where(F.date_trunc("day", "bar_close_at") <= high).select("market_id", "bar_close_at", "idx"))

    def _decide(self, spark: SparkSession, slots: DataFrame, series: DataFrame, held: DataFrame | None, batch_id: int, sent: int) -> int:
        feeds = self.feeds
        slots = cut_lineage(slots)
        span = slots.agg(F.min("cutoff_at").alias("lo"), F.max("cutoff_at").alias("hi")).first()
        items = cut_lineage(news_within_reach(feeds.items.drop(*TEXT_COLUMNS), span["lo"], span["hi"]))
        asked = slots.select(F.when(F.col("market_id").contains("BTC"), "BTC").otherwise("ETH").alias("asset"), "horizon", "cutoff_at").distinct()
        rights = feed_rights(slots.select("cutoff_at").distinct(), feeds.sources, feeds.policies)
        news = news_features(asked, items, feeds.polls, feeds.texts, rights, bodies=feeds.items)
        shown = ["market_id", "bar_start_at", "bar_close_at", "open_usd", "high_usd", "low_usd", "close_usd", "volume", "idx", *feeds.technical]
        bars = series.select(*shown)
        if held is not None:
            bars = bars.unionByName(held.where("_last").select(*shown))
        snap = feature_snapshot(slots, bars, feeds.macro, feeds.flows, news, feeds.sources, feeds.policies, feeds.technical,
                                earlier=self._look_back(spark, slots, batch_id))
        overwrite_batch(snap, f"{self.root}/snapshots", batch_id, "snapshots")
        snap = scan(spark, "snapshots", f"{self.root}/snapshots/batch={batch_id}")
        made = signals(snap, event_blackout(slots, feeds.calendar), feeds.bundles)
        # the daily index needs no order inside a time: markets and horizons break ties
        made = with_row_index(cut_lineage(made), [], [F.col("issued_at"), F.col("market_id"), F.col("horizon")], time_bucket("issued_at", 86400), "sequence")
        made = made.withColumn("sequence", F.col("sequence") + sent)
        overwrite_batch(made, f"{self.root}/signals", batch_id, "signals")
        made = scan(spark, "signals", f"{self.root}/signals/batch={batch_id}")
        overwrite_batch(signal_events(made, snap), f"{self.root}/events", batch_id)
        return made.count()

