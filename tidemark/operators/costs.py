"""Execution prices, eligible quotes, participation and depth over given quote and fill tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import COST_SCENARIOS, by_horizon
from tidemark.functions.timing import plus_seconds, time_bucket
from tidemark.operators.asof import Probe, asof_many
from tidemark.operators.sequence import Carry, with_carry

PRICE = "decimal(18,8)"
RATE = "decimal(7,4)"


def scenario_structs() -> Column:
    """The three cost scenarios as one array literal; rates are fractions of the price."""
    rate = lambda v: F.lit(str(v)).cast(RATE)
    return F.array(*[F.struct(
        F.lit(name).alias("scenario"), rate(fee / 1e4).alias("fee"), rate(impact / 1e4).alias("impact"),
        rate(mult).alias("spread_multiplier"), rate(floor / 1e4).alias("spread_floor"))
        for name, fee, impact, mult, floor, _ in COST_SCENARIOS])


def scenario_delay(scenario: Column, horizon: Column | str = "horizon") -> Column:
    """Extra action delay in seconds: only the severe scenario has one."""
    late = [name for name, *_, severe in COST_SCENARIOS if severe]
    return F.when(scenario.isin(*late), by_horizon("severe_delay_s", horizon)).otherwise(0.0)


def execution_prices(quotes: DataFrame) -> DataFrame:
    """Price and fee per (quote, scenario, side) in exact decimals; a map over the quotes."""
    d = quotes.withColumn("_s", F.explode(scenario_structs())).select(*quotes.columns, "_s.*")
    d = d.withColumn("side", F.explode(F.array(F.lit("BUY"), F.lit("SELL"))))
    bid, ask = F.col("bid").cast(PRICE), F.col("ask").cast(PRICE)
    half = F.lit("0.5").cast("decimal(2,1)")
    mid = ((bid + ask) * half).cast("decimal(20,9)")
    spread = F.greatest(((ask - bid) * F.col("spread_multiplier")).cast("decimal(24,12)"),
                        (mid * F.col("spread_floor")).cast("decimal(24,12)"))
    move = (spread * half).cast("decimal(24,12)")
    buy = F.col("side") == "BUY"
    executable = F.when(buy, mid + move).otherwise(mid - move).cast("decimal(24,12)")
    one = F.lit("1").cast(RATE)
    factor = F.when(buy, one + F.col("impact")).otherwise(one - F.col("impact")).cast(RATE)
    price = (executable * factor).cast("decimal(28,14)")
    return (d.withColumn("mid", mid).withColumn("spread", spread).withColumn("price", price)
            .withColumn("fee_per_unit", (F.col("price") * F.col("fee")).cast("decimal(34,18)"))
            .select(*quotes.columns, "scenario", "side", "mid", "spread", "price", "fee_per_unit"))


def next_quotes(signals: DataFrame, quotes: DataFrame, extra_delay: Column | None = None,
                bucket_s: int = 60) -> DataFrame:
    """First quote of the market observed at or after issue + action delay and before expiry.

    `fill_until` closes the partial-fill window sixty seconds after that quote.
    """
    delay = by_horizon("delay_s") + (extra_delay if extra_delay is not None else F.lit(0.0))
    s = signals.withColumn("eligible_at", plus_seconds("issued_at", delay))
    q = quotes.select("market_id", F.col("observed_at").alias("quote_at"), F.col("book_id").alias("quote_book"),
                      F.col("bid").alias("quote_bid"), F.col("ask").alias("quote_ask"))
    payload = ["quote_at", "quote_book", "quote_bid", "quote_ask"]
    d = asof_many(s, q, ["market_id"], {"_q": Probe("eligible_at")}, "quote_at", payload, tie=["quote_book"], bucket_s=bucket_s, forward=True)
    live = F.col("_q.quote_at") < F.col("expires_at")
    return d.select(*s.columns, *[F.when(live, F.col(f"_q.{c}")).alias(c) for c in payload]) \
            .withColumn("fill_until", plus_seconds("quote_at", 60))


def outcome_prices(decisions: DataFrame, trades: DataFrame, bucket_s: int = 60) -> DataFrame:
    """Entry price (first trade at or after cutoff + delay) and exit price (… + forecast); both are looked up in one pass over the trades."""
    d = (decisions.withColumn("_entry_from", plus_seconds("cutoff_at", by_horizon("delay_s")))
         .withColumn("_exit_from", plus_seconds("_entry_from", by_horizon("forecast_s"))))
    t = trades.select("market_id", F.col("event_time").alias("at"), F.col("price_usd").alias("price"), "trade_id")
    d = asof_many(d, t, ["market_id"], {"_entry": Probe("_entry_from"), "_exit": Probe("_exit_from")}, "at", ["at", "price"], tie=["trade_id"],
                  bucket_s=bucket_s, forward=True)
    return d.select(*decisions.columns, *[F.col(f"_{n}.{c}").alias(f"{n}_{c}") for n in ("entry", "exit") for c in ("at", "price")])


def participation(fills: DataFrame, bucket_s: int = 3600, window_s: int = 60, rate: float = 0.01) -> DataFrame:
    """Notional still allowed at each fill: 1 % of the preceding minute less own fills of the last
    60 seconds (strictly earlier, younger than the window), not below zero; and the quantity cap.

    An asset is cut into time buckets; the last minute of a bucket is repeated in the next one.
    """
    us = F.unix_micros("at")
    width = bucket_s * 1000000
    own = F.floor(us / width).cast("bigint")
    late = us - own * width >= width - window_s * 1000000
    d = (fills.withColumn("_us", us).withColumn("_own", own).withColumn("_notional", F.col("quantity") * F.col("price"))
         .withColumn("_b", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own)))))
    w = Window.partitionBy("asset", "_b").orderBy("_us").rangeBetween(-(window_s * 1000000 - 1), -1)
    used = F.coalesce(F.sum("_notional").over(w), F.lit(0.0))
    allowed = F.greatest(F.lit(0.0), F.col("preceding_minute_notional") * rate - F.col("_used"))
    return (d.withColumn("_used", used).where("_b = _own")
            .withColumn("allowed_notional", allowed)
            .withColumn("quantity_cap", F.least("quantity", "depth", F.col("allowed_notional") / F.col("price")))
            .drop("_us", "_own", "_b", "_notional", "_used"))


def depth_remaining(fills: DataFrame) -> DataFrame:
    """Book depth left before each fill of the same (asset, book, side), not below zero."""
    by = ["asset", "book_id", "side"]
    d = fills.withColumn("_day", time_bucket("at", 86400))
    d = with_carry(d, by, "_day", {"_before": Carry(F.sum("quantity"), F.sum)})
    w = (Window.partitionBy(*by, "_day").orderBy("at", "fill_id")
         .rowsBetween(Window.unboundedPreceding, -1))
    used = F.coalesce("_before", F.lit(0.0)) + F.coalesce(F.sum("quantity").over(w), F.lit(0.0))
    return (d.withColumn("depth_left", F.greatest(F.lit(0.0), F.col("depth") - used))
            .drop("_day", "_before"))


def isolation_reason(market: Column, allowed: list[str], account_currency: str) -> Column:
    """Why a quote may not be used by an account; NULL when it may."""
    usdt = market.endswith("USDT") | market.contains(":USDT")
    usd = market.endswith("-USD") | market.endswith(":USD")
    return (F.when(~market.isin(*allowed), "MARKET_NOT_ALLOWED")
            .when(usdt & F.lit(account_currency == "USD"), "USDT_QUOTE_USD_ACCOUNT")
            .when(usd & F.lit(account_currency == "USDT"), "USD_QUOTE_USDT_ACCOUNT"))
