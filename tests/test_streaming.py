"""Streams replayed from files give the batch result."""

import time
from dataclasses import replace
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.operators import alerts, ledger
from tidemark.operators.bars import ohlcv
from tidemark.operators.indicators import MIN_BARS, continued_indicators, indicators, number_bars
from tidemark.plans.catalog_streams import feeds
from tidemark.session import cut_lineage
from tidemark.sources import testtables as tt
from tidemark.streaming.alerts import AlertJob
from tidemark.streaming.bars import first_seen, streaming_bars
from tidemark.sources.tables import scan
from tidemark.streaming.ledger import pointer_changes, signal_job
from tidemark.streaming.signal_job import SignalJob


def replay(spark, df, folder, order, parts=3):
    """Write df as ordered files and read them back one per micro-batch."""
    rows = df.orderBy(*order).collect()
    step = max(1, -(-len(rows) // parts))
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i:i + step], df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/{i:09d}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(f"{folder}/in")


def drain(stream, folder, name, mode="append"):
    q = (stream.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start())
    q.awaitTermination(240)
    return q


def test_stream_bars_equal_batch_up_to_the_watermark(spark, folder):
    t = tt.trades(spark, SF)
    s = replay(spark, t, folder, ["event_time"])
    drain(streaming_bars(s), folder, "bars")
    got = {tuple(r) for r in spark.table("bars").select("market_id", "bar_close_at", "open_usd", "close_usd", "trade_count").collect()}
    last = t.agg(F.max("event_time")).first()[0]
    # the watermark of the last batch: two seconds before the newest trade
    want = ohlcv(t).where(F.col("bar_close_at") <= F.lit(last) - F.expr("INTERVAL 2 SECONDS"))
    want = {tuple(r) for r in want.select("market_id", "bar_close_at", "open_usd", "close_usd", "trade_count").collect()}
    assert want == got


def test_late_trade_is_dropped(spark, folder):
    def rows(*secs):
        return spark.sql("SELECT * FROM VALUES " + ", ".join(
            f"('{i}', 'binance:BTCUSDT', {100.0 + i}D, 1.0D, 'BUY', timestamp_seconds({s}D))" for i, s in enumerate(secs))
            + " AS t(trade_id, market_id, price_usd, size, side, event_time)")
    for i, batch in enumerate((rows(10.0, 61.0), rows(200.0), rows(205.0), rows(15.0, 300.0))):
        batch.coalesce(1).write.parquet(f"{folder}/in/{i}")
    s = spark.readStream.schema(rows(1.0).schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(f"{folder}/in")
    drain(streaming_bars(s), folder, "late")
    first = spark.table("late").where("unix_seconds(bar_close_at) = 60").collect()
    assert len(first) == 1 and first[0]["trade_count"] == 1


def test_stream_dedup(spark, folder):
    e = tt.outbox(spark, SF).select("id", "dedupe_key", F.col("created_at").alias("occurred_at"))
    twice = e.unionByName(e)
    s = replay(spark, twice, folder, ["occurred_at", "id"])
    drain(first_seen(s, within="40 days"), folder, "dd")
    assert spark.table("dd").count() == e.select("dedupe_key").distinct().count()


def in_batches(df, order, cuts):
    """The rows of df in order, cut at the given shares into frames."""
    rows = df.orderBy(*order).collect()
    at = [0, *(int(len(rows) * c) for c in cuts), len(rows)]
    return [df.sparkSession.createDataFrame(rows[a:b], df.schema) for a, b in zip(at, at[1:], strict=False)]


def sent(spark, folder):
    return sorted(map(tuple, spark.read.parquet(f"{folder}/alerts").select("subscription_id", "signal_id", "reason").collect()))


@pytest.mark.parametrize("cuts", [(), (0.01, 0.5), (0.3, 0.3, 0.31, 0.9)])
def test_stream_alerts_equal_batch_for_any_cut(spark, folder, cuts):
    L, subs = tt.signal_ledger(spark, SF), tt.subscriptions(spark, SF).limit(30)
    job = AlertJob(subs, folder)
    for i, batch in enumerate(in_batches(L, ["issued_at", "sequence"], cuts)):
        job(batch, i)
        job(batch, i)   # a repeated batch sends nothing twice
    want = sorted(map(tuple, alerts.dispatch(L, subs).select("subscription_id", "signal_id", "reason").collect()))
    assert sent(spark, folder) == want and want


def plain_admitted(times, cool, reset, limit=8):
    last, day, count, out = None, None, 0, []
    for i, t in enumerate(times):
        if reset and t // alerts.DAY_US != day:
            day, count = t // alerts.DAY_US, 0
        if count < limit and (last is None or t - last >= cool):
            last, count = t, count + 1
            out.append(i)
    return out


def test_jumps_equal_a_walk_over_all_signals():
    r = np.random.default_rng(2)
    for n in (0, 1, 50, 400):
        for cool in (0, 1, 3_600_000_000, 2 * alerts.DAY_US):
            for reset in (True, False):
                t = np.sort(r.integers(0, 5 * alerts.DAY_US, n) // r.choice([1, 10**9]))
                cut = int(r.integers(0, n + 1))
                state = alerts.Cooldown(reset=reset)
                got = state.admitted(t[:cut], cool)
                got += [cut + i for i in state.admitted(t[cut:], cool)]
                assert got == plain_admitted(t.tolist(), cool, reset)


def test_a_million_signals_cost_as_many_steps_as_alerts():
    t = np.arange(1_000_000, dtype=np.int64) * 1_000_000
    started = time.perf_counter()
    got = alerts.Cooldown().admitted(t, 60_000_000)
    assert len(got) == 8 * 12 and time.perf_counter() - started < 1


@pytest.mark.parametrize("cuts", [(), (0.5,), (0.1, 0.11, 0.7)])
def test_change_feed_equals_batch_for_any_cut(spark, folder, cuts):
    L = tt.signal_ledger(spark, SF)
    for i, batch in enumerate(in_batches(L, ["cutoff_at", "sequence"], cuts)):
        for _ in range(1 + i % 2):
            pointer_changes(batch, f"{folder}/p", f"{folder}/c", i)
    cols = ["market_id", "horizon", "signal_id", "previous_id"]
    got = spark.read.parquet(f"{folder}/c").select(*cols).collect()
    assert sorted(map(str, got)) == sorted(map(str, ledger.change_feed(L).select(*cols).collect())) and len(got) > 100


def test_older_signal_changes_nothing(spark, folder):
    first, second = in_batches(tt.signal_ledger(spark, SF), ["cutoff_at", "sequence"], (0.5,))
    pointer_changes(second, f"{folder}/p", f"{folder}/c", 0)
    pointer_changes(first.join(second.select("market_id", "horizon").distinct(), ["market_id", "horizon"], "left_semi"), f"{folder}/p", f"{folder}/c", 1)
    assert spark.read.parquet(f"{folder}/c/batch=1").count() == 0


def test_pointer_and_change_feed_survive_a_repeated_batch(spark, folder):
    L = tt.signal_ledger(spark, SF).orderBy("issued_at", "sequence").collect()
    df = spark.createDataFrame(L, tt.signal_ledger(spark, SF).schema)
    cut = len(L) // 2
    halves = [spark.createDataFrame(L[:cut], df.schema), spark.createDataFrame(L[cut:], df.schema)]
    for i in (0, 1, 1):
        pointer_changes(halves[i], f"{folder}/p", f"{folder}/c", i)
    got = spark.read.parquet(f"{folder}/p/batch=1").select("market_id", "horizon", "signal_id").collect()
    want = ledger.current_signal(df).select("market_id", "horizon", "signal_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert spark.read.parquet(f"{folder}/c/batch=0").count() > 0


def test_pointer_goes_on_from_the_newest_earlier_batch(spark, folder):
    L = tt.signal_ledger(spark, SF).limit(400).collect()
    schema = tt.signal_ledger(spark, SF).schema
    first, second = spark.createDataFrame(L[:200], schema), spark.createDataFrame(L[200:], schema)
    pointer_changes(first, f"{folder}/p", f"{folder}/c", 0)
    pointer_changes(second, f"{folder}/p", f"{folder}/c", 5)   # batches 1 to 4 wrote nothing
    got = spark.read.parquet(f"{folder}/p/batch=5").select("market_id", "horizon", "signal_id").collect()
    want = ledger.current_signal(first.unionByName(second)).select("market_id", "horizon", "signal_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    with pytest.raises(RuntimeError):
        pointer_changes(second, f"{folder}/lost", f"{folder}/c", 3)


def test_stream_alerts_remember_a_signal_without_confidence(spark, folder):
    rows = [("S0", 0, "Buy", 0.9, 0), ("S1", 1, "Sell", None, 2000), ("S2", 2, "Sell", 0.9, 4000), ("S3", 3, "Buy", 0.9, 9000)]
    L = spark.createDataFrame(rows, "signal_id string, sequence bigint, label string, confidence double, s int").selectExpr(
        "signal_id", "sequence", "'binance:BTCUSDT' AS market_id", "'scalp_15m' AS horizon", "label", "confidence",
        "'READY' AS status", "false AS is_replay", "timestamp_seconds(s) AS issued_at", "timestamp_seconds(s + 90) AS expires_at")
    subs = spark.sql("SELECT 1L AS subscription_id, 'binance:BTCUSDT' AS market_id, 'scalp_15m' AS horizon, 0.6D AS min_confidence,"
                     " array('Buy', 'Sell') AS allowed_labels")
    job = AlertJob(subs, folder)
    for i, batch in enumerate(in_batches(L, ["issued_at", "sequence"], (0.5,))):
        job(batch, i)
    got = sorted(r[1] for r in sent(spark, folder))
    assert got == sorted(r["signal_id"] for r in alerts.dispatch(L, subs).collect()) == ["S0", "S3"]


def test_signal_job_rerun_changes_nothing(spark, folder):
    d = tt.decisions(spark, SF)
    job = signal_job(lambda b: {"signals": b.withColumn("issued_at", F.col("cutoff_at")), "events": b.select("market_id")}, folder)
    for _ in range(2):
        job(d, 7)
    assert scan(spark, "signals", f"{folder}/signals").count() == d.count()
    late = d.agg(F.max("cutoff_at")).first()[0]
    assert scan(spark, "signals", f"{folder}/signals", start=late).count() == d.where(F.col("cutoff_at") == F.lit(late)).count()
    assert spark.read.parquet(f"{folder}/events").count() == d.count()


@pytest.mark.parametrize("reset,expected", [(True, 9), (False, 8)])
def test_daily_quota(spark, reset, expected):
    """Twelve label changes on day one (eight are sent), one on day two."""
    rows = [(f"S{i}", i, "Buy" if i % 2 else "Sell", i * 1000) for i in range(12)] + [("S99", 99, "Sell", 90000)]
    L = spark.createDataFrame(rows, "signal_id string, sequence bigint, label string, s int").selectExpr(
        "signal_id", "sequence", "'binance:BTCUSDT' AS market_id", "'scalp_15m' AS horizon", "label", "0.9D AS confidence",
        "'READY' AS status", "false AS is_replay", "timestamp_seconds(s) AS issued_at", "timestamp_seconds(s + 90) AS expires_at")
    subs = spark.sql("SELECT 1L AS subscription_id, 'binance:BTCUSDT' AS market_id, 'scalp_15m' AS horizon, 0.6D AS min_confidence,"
                     " array('Buy', 'Sell') AS allowed_labels")
    assert alerts.dispatch(L, subs, daily_reset=reset).count() == expected


def test_indicators_go_on_from_the_saved_end(spark):
    """Any cut of the series into batches gives the indicators of the whole series."""
    series = number_bars(ohlcv(tt.trades(spark, SF), 3600))
    want = {(r["market_id"], r["idx"]): r for r in indicators(series).collect()}
    tail, seen = None, 0
    for lo, hi in ((1, 3), (4, 33), (34, 34), (35, 300), (301, 10**9)):
        new = series.where(F.col("idx").between(lo, hi)).withColumn("_pos", F.col("idx") - (lo - 1))
        got = continued_indicators(new, tail)
        for r in got.collect():
            seen += 1
            for n in MIN_BARS:
                a, b = r[n], want[r["market_id"], r["idx"]][n]
                assert (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-9 * max(1, abs(b))), (n, r["idx"])
        rows = got if tail is None else got.unionByName(tail.drop("_last"))
        top = rows.groupBy("market_id").agg(F.max("idx").alias("_top"))
        tail = cut_lineage(rows.join(top, "market_id").where("idx > _top - 20").withColumn("_last", F.col("idx") == F.col("_top")).drop("_top"))
    assert seen == len(want)


def test_signal_job_rerun_of_a_batch_changes_nothing(spark, folder):
    series = ohlcv(tt.trades(spark, SF), 3600)
    start = series.agg(F.min("bar_close_at")).first()[0]
    days = lambda n: F.lit(start) + F.expr(f"INTERVAL {n} DAYS")
    full = feeds(spark, SF)
    job = SignalJob(replace(full, decisions=full.decisions.where(F.col("cutoff_at") < days(2)), items=full.items.limit(0),
                            technical=("tech_ema_12", "tech_bb_pct_b", "tech_ewma_volatility")), folder)
    first, second = series.where(F.col("bar_close_at") < days(1)), series.where(F.col("bar_close_at").between(days(1), days(2)))
    job(first, 0)
    job(second.unionByName(first), 1)   # late and repeated bars are dropped
    once = sorted(map(str, spark.read.parquet(f"{folder}/signals").drop("part").collect()))
    job(second, 1)
    assert sorted(map(str, spark.read.parquet(f"{folder}/signals").drop("part").collect())) == once
    job.finish(spark, start + timedelta(days=2), 2)
    got = spark.read.parquet(f"{folder}/signals")
    assert got.count() == got.select("market_id", "horizon", "cutoff_at").distinct().count() == job.feeds.decisions.where(F.col("cutoff_at") <= days(2)).count()
    assert sorted(r[0] for r in got.select("sequence").collect()) == list(range(1, got.count() + 1))
    events = spark.read.parquet(f"{folder}/events")
    assert events.select("dedupe_key").distinct().count() == got.count()
    assert events.select(F.get_json_object("payload", "$.sequence").cast("bigint").alias("s")).agg(F.max("s")).first()[0] == got.count()
