"""Market queries: scans, bars, as-of joins, indicators, checks, execution data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.checks import (
    envelope_problems,
    market_id_parts,
    quote_problems,
    violations,
)
from tidemark.functions.timing import plus_seconds, time_bucket
from tidemark.operators import bars as B
from tidemark.operators import costs, ledger
from tidemark.operators.etf import reconcile
from tidemark.operators.indicators import indicators, number_bars
from tidemark.operators.macro import rate_changes, yield_slope
from tidemark.operators.reference import asof_etf, asof_macro
from tidemark.plans.registry import plain, query
from tidemark.sources import tables
from tidemark.sources import testtables as tt


@query
def ohlcv_bars(spark, sf):
    t = tt.trades(spark, sf)
    minute, hour = (B.ohlcv(t, w).withColumn("width_s", F.lit(w)) for w in (60, 3600))
    return plain(minute.unionByName(hour), 9)


@query
def scan_trades_window(spark, sf):
    return plain(B.trades_window(tt.trades(spark, sf), "binance:BTCUSDT",
                                 "2024-01-05 00:00:00", "2024-01-12 12:30:00"))


@query
def latest_trade(spark, sf):
    return plain(B.latest_trade(tt.trades(spark, sf)))


@query
def partition_layout(spark, sf):
    t = tt.trades(spark, sf)
    count = lambda df, name: (tables.with_partition(df, name).groupBy("part")
                              .agg(F.count(F.lit(1)).alias("n")).withColumn("table_name", F.lit(name)))
    return plain(count(t, "trades").unionByName(count(B.ohlcv(t), "bars"))
                 .unionByName(count(tt.signal_ledger(spark, sf), "signals"))
                 .unionByName(count(tt.quotes(spark, sf), "quotes")))


@query
def event_envelope(spark, sf):
    e = tables.event_envelope(B.ohlcv(tt.trades(spark, sf)))
    p = F.from_json("payload", "market_id string, open_time string, close_time string, available_at string,"
                               " close_usd double, volume double, vwap_usd double")
    return plain(e.withColumn("p", p).select(
        "dedupe_key", "subject", "occurred_at", "source", "is_replay", "too_large", "p.open_time",
        "p.available_at", "p.close_usd", "p.volume", "p.vwap_usd"))


@query
def bar_checks(spark, sf):
    """Bars with some values spoilt by rule, so every violation occurs."""
    b = B.ohlcv(tt.trades(spark, sf), 3600)
    hour = time_bucket("bar_start_at", 3600)
    b = (b.withColumn("high_usd", F.when(hour % 11 == 0, F.col("low_usd") - 1).otherwise(F.col("high_usd")))
         .withColumn("low_usd", F.when(hour % 13 == 0, F.col("high_usd") + 5).otherwise(F.col("low_usd")))
         .withColumn("open_usd", F.when(hour % 17 == 0, -F.col("open_usd")).otherwise(F.col("open_usd")))
         .withColumn("volume", F.when(hour % 19 == 0, -F.col("volume")).otherwise(F.col("volume")))
         .withColumn("bar_close_at", F.when(hour % 23 == 0, F.col("bar_start_at")).otherwise(F.col("bar_close_at"))))
    return plain(b.select("market_id", "bar_start_at",
                          F.array_join(violations(B.bar_problems()), ",").alias("violations")))


@query
def market_id_parts_query(spark, sf):
    e = tt.read(spark, sf, "events").withColumn(
        "raw", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("Binance:"), "event_type"))
        .when(F.col("event_id") % 5 == 1, F.col("event_type"))
        .when(F.col("event_id") % 5 == 2, F.concat("event_type", F.lit(":"), F.upper("event_type"), F.lit("-USD")))
        .when(F.col("event_id") % 5 == 3, F.concat("event_type", F.lit(":BTC USD")))
        .otherwise(F.expr(tt.market_of("user_id"))))
    n = e.groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    return plain(n.select("raw", "n", *[c.alias(k) for k, c in market_id_parts("raw").items()]))


@query
def envelope_checks(spark, sf):
    m = tt.macro_observations(spark, sf)
    day = F.expr("INTERVAL 1 DAY")
    m = (m.withColumn("first_seen_at", F.when(F.col("record_id") % 13 == 0, F.col("available_at") + day)
                      .otherwise(F.col("available_at") - day))
         .withColumn("valid_from", F.col("available_at"))
         .withColumn("valid_to", F.when(F.col("record_id") % 7 == 0, F.lit(None).cast("timestamp"))
                     .when(F.col("record_id") % 11 == 0, F.col("available_at") - day)
                     .otherwise(F.col("available_at") + day)))
    return plain(m.select("record_id", F.array_join(violations(envelope_problems()), ",").alias("violations")))


@query
def quote_checks(spark, sf):
    q = tt.quotes(spark, sf)
    i = F.col("event_id")
    q = (q.withColumn("bid", F.when(i % 11 == 0, -F.col("bid")).when(i % 13 == 0, F.col("ask") + 1)
                      .otherwise(F.col("bid")))
         .withColumn("available_at", F.when(i % 17 == 0, F.col("observed_at") - F.expr("INTERVAL 1 SECOND"))
                     .otherwise(F.col("available_at")))
         .withColumn("asset", F.when(i % 19 == 0, "SOL").otherwise(F.col("asset")))
         .withColumn("book_id", F.when(i % 23 == 0, "").otherwise(F.col("book_id"))))
    frame = plus_seconds("observed_at", 1)
    return plain(q.select("event_id", F.array_join(violations(quote_problems(frame)), ",").alias("violations")))


@query
def market_isolation(spark, sf):
    """Rejected and admitted quotes per market for a dollar account on two dollar markets, and
    the number of distinct markets per hour."""
    q = tt.quotes(spark, sf)
    usd = costs.isolation_reason(F.col("market_id"), list(tt.MARKETS[1:]), "USD")
    usdt = costs.isolation_reason(F.col("market_id"), list(tt.MARKETS), "USDT")
    by_market = q.select("market_id", usd.alias("usd_reason"), usdt.alias("usdt_reason"))
    steps = (q.groupBy(F.date_trunc("hour", "observed_at").alias("h"))
             .agg(F.size(F.collect_set("market_id")).alias("markets"))
             .groupBy("markets").agg(F.count(F.lit(1)).alias("n"))
             .select(F.concat(F.lit("hours with "), "markets", F.lit(" markets")).alias("market_id"),
                     F.lit("").alias("usd_reason"), F.lit("").alias("usdt_reason"), "n"))
    return plain(by_market.groupBy("market_id", "usd_reason", "usdt_reason").agg(F.count(F.lit(1)).alias("n"))
                 .select("market_id", F.coalesce("usd_reason", F.lit("OK")).alias("usd_reason"),
                         F.coalesce("usdt_reason", F.lit("OK")).alias("usdt_reason"), "n").unionByName(steps))


@query
def asof_bar(spark, sf):
    b = number_bars(B.ohlcv(tt.trades(spark, sf)))
    return plain(B.asof_bar(tt.decisions(spark, sf), b, ["close_usd", "volume"]))


def macro_columns(d):
    return d.select("cutoff_at", F.col("cpi.record_id").alias("cpi_record"), F.col("cpi.value").alias("cpi_level"),
                    F.col("cpi.mom_pct").alias("cpi_mom_pct"), F.col("effr.record_id").alias("effr_record"),
                    F.col("effr.value").alias("effr_rate"))


@query
def asof_macro_query(spark, sf):
    cut = tt.decisions(spark, sf).select("cutoff_at").distinct()
    return plain(macro_columns(asof_macro(cut, tt.macro_observations(spark, sf))))


@query
def asof_etf_query(spark, sf):
    cut = (tt.decisions(spark, sf).select("cutoff_at").distinct()
           .withColumn("asset", F.explode(F.array(F.lit("BTC"), F.lit("ETH")))))
    d = asof_etf(cut, reconcile(tt.etf_cells(spark, sf)))
    return plain(d.select("asset", "cutoff_at", "etf.record_id", "etf.session_date",
                          "etf.flow_usd", "etf.coverage_ratio", "etf.status"), 2)


@query
def etf_reconcile(spark, sf):
    d = reconcile(tt.etf_cells(spark, sf))
    return plain(d.select("asset_id", "session_date", "status", "flow_usd", "covered_funds", "expected_funds",
                          "coverage_ratio", "is_complete", "available_at"), 2)


@query
def macro_mom_yoy(spark, sf):
    return plain(tt.macro_observations(spark, sf).select(
        "series_id", "revision_seq", "reference_period", "record_id", "value", "mom_pct", "yoy_pct"))


@query
def rates_bps_slope(spark, sf):
    m = tt.macro_observations(spark, sf)
    ch = rate_changes(m, ("US_EFFR", "US_UST_2Y", "US_UST_10Y")).select("series_id", "reference_period", "change_bps")
    return plain(ch.join(yield_slope(m), "reference_period"))


@query
def superseded_anti(spark, sf):
    """Each revision replaces the one before it in its (series, period) chain."""
    from pyspark.sql import Window
    m = tt.macro_observations(spark, sf)
    w = Window.partitionBy("series_id", "reference_period").orderBy("revision_seq")
    m = m.withColumn("supersedes_id", F.lag("record_id").over(w))
    return plain(ledger.not_superseded(m).select("record_id", "series_id", "reference_period", "revision_seq"))


def _indicator(*names):
    def run(spark, sf):
        b = B.ohlcv(tt.trades(spark, sf))
        return plain(indicators(b, names).select("market_id", "bar_close_at", *names), 5)
    return run


for _name, _cols in {
    "tech_rsi": ("tech_rsi_14",),
    "tech_macd": ("tech_macd", "tech_macd_signal", "tech_macd_hist"),
    "tech_bollinger": ("tech_bb_upper", "tech_bb_middle", "tech_bb_lower", "tech_bb_pct_b"),
    "tech_ema": ("tech_ema_12", "tech_ema_26", "tech_ema_50", "tech_ema_200"),
    "tech_atr": ("tech_atr_14",),
    "tech_ewma_vol": ("tech_ewma_volatility",),
}.items():
    _f = _indicator(*_cols)
    _f.__name__ = _name
    query(_f)


@query
def next_quote(spark, sf):
    d = costs.next_quotes(tt.paper_signals(spark, sf), tt.quotes(spark, sf))
    return plain(d.select("signal_id", "market_id", "horizon", "eligible_at", "quote_at", "quote_book",
                          "quote_bid", "quote_ask", "fill_until"), 8)


@query
def outcome_prices(spark, sf):
    return plain(costs.outcome_prices(tt.decisions(spark, sf), tt.trades(spark, sf)))


@query
def execution_price(spark, sf):
    d = costs.execution_prices(tt.quotes(spark, sf).select("event_id", "bid", "ask"))
    return plain(d.select("event_id", "scenario", "side", "mid", "spread", "price",
                          F.round(F.col("fee_per_unit").cast("double"), 6).alias("fee_per_unit")), 12)


@query
def participation_cap(spark, sf):
    d = costs.participation(tt.fills(spark, sf), window_s=60)
    return plain(d.select("fill_id", "asset", "allowed_notional", "quantity_cap"))


@query
def depth_remaining(spark, sf):
    return plain(costs.depth_remaining(tt.fills(spark, sf)).select("fill_id", "depth_left"))


from tidemark.plans.registry import QUERIES  # noqa: E402

for _old, _new in (("market_id_parts_query", "market_id_parts"), ("asof_macro_query", "asof_macro"),
                   ("asof_etf_query", "asof_etf")):
    QUERIES[_new] = QUERIES.pop(_old)
