"""Technical indicators for every bar of every market in one pass.

All recurrences are y_t = a·y_{t−1} + b_t. A moving-average seed over the first n bars is the
same as giving those bars b = x/n·a^(position − n), so no market needs special treatment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timing import time_bucket
from tidemark.operators.sequence import Affine, affine_scan, with_blocks, with_row_index
from tidemark.session import cut_lineage

BLOCK_ROWS = 2048
HALO = 19
EMA_PERIODS = (12, 26, 50, 200)
EWMA_DECAY = 0.94

# value columns of an indicator row and the bars each one needs
MIN_BARS = {
    "tech_close": 2, "tech_volume": 2, "tech_rsi_14": 15,
    "tech_macd": 35, "tech_macd_signal": 35, "tech_macd_hist": 35,
    "tech_bb_upper": 20, "tech_bb_middle": 20, "tech_bb_lower": 20, "tech_bb_pct_b": 20,
    "tech_ema_12": 12, "tech_ema_26": 26, "tech_ema_50": 50, "tech_ema_200": 200,
    "tech_atr_14": 15, "tech_ewma_volatility": 2,
}


def seeded(x: Column, pos: Column, first: int, n: int, a: float, gain: float) -> Column:
    """b_t of a smoother that starts as the mean of rows first..first+n−1."""
    last = first + n - 1
    return (F.when(pos < first, F.lit(0.0))
            .when(pos <= last, x / n * F.pow(F.lit(a), pos - last))
            .otherwise(x * gain))


def number_bars(bars: DataFrame) -> DataFrame:
    """Position of each bar in its market.

    Later steps read the numbered bars several times, so the numbering is written once.
    """
    return cut_lineage(with_row_index(bars, ["market_id"], [F.col("bar_close_at")],
                                      time_bucket("bar_close_at", 86400)))


def _ema(name: str, x: Column, n: int, first: int = 1) -> Affine:
    alpha = 2.0 / (n + 1)
    return Affine(name, 1.0 - alpha, seeded(x, F.col("idx"), first, n, 1.0 - alpha, alpha))


def _wilder(name: str, x: Column, n: int) -> Affine:
    a = (n - 1.0) / n
    return Affine(name, a, seeded(x, F.col("idx"), 2, n, a, 1.0 / n))


def _recurrences(d: DataFrame, need: set[str], position: str, carried: bool) -> tuple[DataFrame, list[str]]:
    """Own rows of blocked bars with every raw column of `need`, and the names of the recurrences that ran.

    `position` numbers the rows that are scanned, `idx` is the place of a bar in its market. With `carried` the first row scanned goes on from
    the values `_y_<name>` of the bar before it.
    """
    by = ["market_id"]
    order = Window.partitionBy("market_id", "_block").orderBy("idx")
    back20 = order.rowsBetween(-HALO, 0)
    close, idx = F.col("close_usd"), F.col("idx")
    d = d.withColumn("_prev", F.lag("close_usd").over(order))
    if need & {"tech_bb_upper", "tech_bb_middle", "tech_bb_lower", "tech_bb_pct_b"}:
        d = (d.withColumn("tech_bb_middle", F.avg("close_usd").over(back20))
             .withColumn("_sd", F.stddev_pop("close_usd").over(back20)))
    d = d.where("_own")
    ran: list[str] = []

    def scan(d: DataFrame, specs: list[Affine]) -> DataFrame:
        ran.extend(s.name for s in specs)
        if carried:
            first = F.col(position) == 1
            specs = [Affine(s.name, s.a, F.coalesce(s.b, F.lit(0.0)) + F.when(
                first, F.lit(s.a) * F.coalesce(F.col(f"_y_{s.name}"), F.lit(0.0))).otherwise(0.0)) for s in specs]
        return affine_scan(d, by, position, BLOCK_ROWS, specs)

    change = close - F.col("_prev")
    true_range = F.greatest(F.col("high_usd") - F.col("low_usd"),
                            F.abs(F.col("high_usd") - F.col("_prev")),
                            F.abs(F.col("low_usd") - F.col("_prev")))
    specs: list[Affine] = []
    for n in EMA_PERIODS:
        if f"tech_ema_{n}" in need or (n == 26 and "tech_macd" in need):
            specs.append(_ema(f"tech_ema_{n}", close, n))
    if "tech_rsi_14" in need:
        specs += [_wilder("_gain", F.greatest(change, F.lit(0.0)), 14),
                  _wilder("_loss", F.greatest(-change, F.lit(0.0)), 14)]
    if "tech_atr_14" in need:
        specs.append(_wilder("tech_atr_14", true_range, 14))
    if "tech_ewma_volatility" in need:
        r = F.ln(close / F.col("_prev"))
        specs.append(Affine("_var", EWMA_DECAY,
                            F.when(idx >= 2, (1.0 - EWMA_DECAY) * r * r).otherwise(0.0)))
    if "tech_macd" in need:
        specs.append(_ema("_fast", close, 12, first=15))
    if specs:
        d = scan(d, specs)
    if "tech_macd" in need:
        d = d.withColumn("tech_macd", F.col("_fast") - F.col("tech_ema_26"))
        d = scan(d, [_ema("tech_macd_signal", F.col("tech_macd"), 9, first=26)])
    return d, ran


def _finished(d: DataFrame, wanted: tuple[str, ...]) -> dict[str, Column]:
    """The wanted indicators from raw columns; NULL until enough bars exist."""
    need, have, idx, close = set(wanted), set(d.columns), F.col("idx"), F.col("close_usd")
    raw = {n: F.col(n) for n in wanted if n in have}
    raw |= {"tech_close": close, "tech_volume": F.col("volume")}
    if "tech_macd" in need:
        raw["tech_macd_hist"] = F.col("tech_macd") - F.col("tech_macd_signal")
    if "_sd" in have:
        upper = F.col("tech_bb_middle") + 2.0 * F.col("_sd")
        lower = F.col("tech_bb_middle") - 2.0 * F.col("_sd")
        raw |= {"tech_bb_upper": upper, "tech_bb_lower": lower,
                "tech_bb_pct_b": F.when(upper - lower > 0, (close - lower) / (upper - lower)).otherwise(0.5)}
    if "tech_rsi_14" in need:
        both = F.col("_gain") + F.col("_loss")
        raw["tech_rsi_14"] = F.when(both != 0, 100.0 * F.col("_gain") / both).otherwise(0.0)
    if "tech_ewma_volatility" in need:
        mass = 1.0 - F.pow(F.lit(EWMA_DECAY), idx - 1)
        raw["tech_ewma_volatility"] = F.sqrt(F.greatest(
            F.lit(0.0), F.when(mass > 1e-9, F.col("_var") / mass).otherwise(F.col("_var"))))
    return {n: F.when(idx >= MIN_BARS[n], raw[n]).alias(n) for n in wanted}


def indicators(bars: DataFrame, wanted: tuple[str, ...] = tuple(MIN_BARS)) -> DataFrame:
    """Bars with `idx` and the wanted indicator columns; NULL until enough bars exist."""
    d = bars if "idx" in bars.columns else number_bars(bars)
    d, _ = _recurrences(with_blocks(d, "idx", BLOCK_ROWS, HALO), set(wanted), "idx", carried=False)
    return d.select(*[c for c in bars.columns if c != "idx"], "idx", *_finished(d, wanted).values())


def continued_indicators(new: DataFrame, tail: DataFrame | None, wanted: tuple[str, ...] = tuple(MIN_BARS)) -> DataFrame:
    """Indicators of new bars from the saved end of the series: the same values as from the whole series.

    `new` has `idx` (place in the market) and `_pos` (1, 2, … among the new bars of the market). `tail` holds the last HALO + 1 earlier bars of
    each market with `idx`, and on the last one the values `_y_<name>` of the recurrences, as this function returns them.
    Work grows with the new bars only.
    """
    base = [c for c in new.columns if c not in ("idx", "_pos")]
    d = with_blocks(new, "_pos", BLOCK_ROWS, HALO)
    if tail is not None:
        kept = [c for c in tail.columns if c.startswith("_y_")]
        old = tail.select(*base, "idx", F.lit(0).cast("bigint").alias("_pos"), F.lit(0).cast("bigint").alias("_block"), F.lit(False).alias("_own"))
        d = d.unionByName(old).join(tail.where(F.col("_last")).select("market_id", *kept), "market_id", "left")
    d, ran = _recurrences(d, set(wanted), "_pos", carried=tail is not None)
    return d.select(*base, "idx", *_finished(d, wanted).values(), *[F.col(n).alias(f"_y_{n}") for n in ran])
