"""DuckDB text for the market queries."""

from oracles.fixtures import cte, sql, ts

ORACLES: dict[str, str] = {}


def r(x, n=6):
    return f"round({x}, {n}) + 0.0::DOUBLE"


def bars_sql(width):
    return f"""
SELECT market_id, arg_min(price_usd, (event_time, trade_id)) AS open_usd, max(price_usd) AS high_usd,
  min(price_usd) AS low_usd, arg_max(price_usd, (event_time, trade_id)) AS close_usd, sum(size) AS volume,
  count(*) AS trade_count, sum(price_usd * size) / sum(size) AS vwap_usd,
  make_timestamp(epoch_us(event_time) // {width}000000 * {width}000000) AS bar_start_at,
  make_timestamp((epoch_us(event_time) // {width}000000 + 1) * {width}000000) AS bar_close_at
FROM f_trades GROUP BY market_id, epoch_us(event_time) // {width}000000"""


cte("bars60", bars_sql(60))
cte("bars3600", bars_sql(3600))
for w in (60, 3600):
    cte(f"num{w}", f"SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY bar_close_at) AS idx FROM bars{w}")

_bar = ", ".join(f"{r(c, 9)} AS {c}" for c in ("open_usd", "high_usd", "low_usd", "close_usd", "volume", "vwap_usd"))
ORACLES["ohlcv_bars"] = " UNION ALL ".join(
    f"SELECT market_id, {_bar}, trade_count, {ts('bar_start_at')} AS bar_start_at, {ts('bar_close_at')} AS bar_close_at,"
    f" CAST({w} AS BIGINT) AS width_s FROM bars{w}" for w in (60, 3600))

_trade = f"{r('price_usd')} AS price_usd, {r('size')} AS size, side, {ts('event_time')} AS event_time"
ORACLES["scan_trades_window"] = f"""SELECT trade_id, market_id, {_trade} FROM f_trades
WHERE market_id = 'binance:BTCUSDT' AND event_time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:30:00'"""
ORACLES["latest_trade"] = f"""SELECT market_id, trade_id, {_trade} FROM f_trades
QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY event_time DESC, trade_id DESC) = 1"""
ORACLES["partition_layout"] = """
SELECT strftime(date_trunc('day', event_time), '%Y-%m-%d') AS part, count(*) AS n, 'trades' AS table_name FROM f_trades GROUP BY 1
UNION ALL SELECT strftime(date_trunc('month', bar_close_at), '%Y-%m-%d'), count(*), 'bars' FROM bars60 GROUP BY 1
UNION ALL SELECT strftime(date_trunc('month', issued_at), '%Y-%m-%d'), count(*), 'signals' FROM f_ledger GROUP BY 1
UNION ALL SELECT strftime(date_trunc('day', observed_at), '%Y-%m-%d'), count(*), 'quotes' FROM f_quotes GROUP BY 1"""
_iso = "'%Y-%m-%dT%H:%M:%S.%f+00:00'"
ORACLES["event_envelope"] = f"""
SELECT market_id || '-' || strftime(bar_close_at, {_iso}) AS dedupe_key, 'raw.market.v1.' || market_id AS subject,
  {ts('bar_close_at')} AS occurred_at, 'market-collector' AS source, FALSE AS is_replay, FALSE AS too_large,
  strftime(bar_start_at, {_iso}) AS open_time, strftime(bar_close_at + INTERVAL 2 SECOND, {_iso}) AS available_at,
  {r('close_usd')} AS close_usd, {r('volume')} AS volume, {r('vwap_usd')} AS vwap_usd FROM bars60"""

ORACLES["bar_checks"] = f"""
SELECT market_id, {ts('bar_start_at')} AS bar_start_at, concat_ws(',',
  CASE WHEN bar_start_at >= c2 THEN 'clock' END,
  CASE WHEN least(o2, h2, l2, close_usd) <= 0 THEN 'price_not_positive' END,
  CASE WHEN h2 < greatest(o2, close_usd) THEN 'high_too_low' END,
  CASE WHEN l2 > least(o2, close_usd) THEN 'low_too_high' END,
  CASE WHEN v2 < 0 THEN 'negative_volume' END) AS violations
FROM (SELECT *, CASE WHEN h % 13 = 0 THEN h2 + 5 ELSE low_usd END AS l2,
        CASE WHEN h % 17 = 0 THEN -open_usd ELSE open_usd END AS o2,
        CASE WHEN h % 19 = 0 THEN -volume ELSE volume END AS v2,
        CASE WHEN h % 23 = 0 THEN bar_start_at ELSE bar_close_at END AS c2
      FROM (SELECT *, CASE WHEN h % 11 = 0 THEN low_usd - 1 ELSE high_usd END AS h2
            FROM (SELECT *, epoch_us(bar_start_at) // 3600000000 AS h FROM bars3600)))"""

ORACLES["market_id_parts"] = """
SELECT raw, n, ok AS valid, CASE WHEN ok THEN split_part(raw, ':', 1) END AS venue,
  CASE WHEN ok THEN split_part(raw, ':', 2) END AS symbol
FROM (SELECT raw, count(*) AS n, regexp_matches(raw, '^[a-z0-9_-]+:[A-Za-z0-9_-]+$') AS ok FROM (
  SELECT CASE event_id % 5 WHEN 0 THEN 'Binance:' || event_type WHEN 1 THEN event_type
    WHEN 2 THEN event_type || ':' || upper(event_type) || '-USD' WHEN 3 THEN event_type || ':BTC USD'
    ELSE CASE user_id % 4 WHEN 0 THEN 'binance:BTCUSDT' WHEN 1 THEN 'binance:ETHUSDT'
      WHEN 2 THEN 'coinbase:BTC-USD' ELSE 'coinbase:ETH-USD' END END AS raw FROM events) GROUP BY raw)"""

ORACLES["envelope_checks"] = """
SELECT record_id, concat_ws(',', CASE WHEN record_id % 13 = 0 THEN 'seen_after_available' END,
  CASE WHEN record_id % 7 <> 0 AND record_id % 11 = 0 THEN 'valid_interval' END) AS violations FROM f_macro"""

ORACLES["quote_checks"] = """
SELECT event_id, concat_ws(',',
  CASE WHEN b < 0 THEN 'amount' END, CASE WHEN NOT (b > 0 AND b <= ask) THEN 'spread' END,
  CASE WHEN observed_at > a THEN 'clock' END, CASE WHEN event_id % 19 = 0 THEN 'asset' END,
  CASE WHEN event_id % 23 = 0 THEN 'book' END,
  CASE WHEN a > observed_at + INTERVAL 1 SECOND THEN 'future_quote' END) AS violations
FROM (SELECT *, CASE WHEN event_id % 11 = 0 THEN -bid WHEN event_id % 13 = 0 THEN ask + 1 ELSE bid END AS b,
        CASE WHEN event_id % 17 = 0 THEN observed_at - INTERVAL 1 SECOND ELSE available_at END AS a FROM f_quotes)"""

ORACLES["market_isolation"] = """
SELECT market_id, CASE market_id WHEN 'binance:BTCUSDT' THEN 'MARKET_NOT_ALLOWED'
    WHEN 'binance:ETHUSDT' THEN 'USDT_QUOTE_USD_ACCOUNT' ELSE 'OK' END AS usd_reason,
  CASE WHEN market_id LIKE 'coinbase%' THEN 'USD_QUOTE_USDT_ACCOUNT' ELSE 'OK' END AS usdt_reason, count(*) AS n
FROM f_quotes GROUP BY market_id
UNION ALL SELECT 'hours with ' || m || ' markets', '', '', count(*) FROM
 (SELECT count(DISTINCT market_id) AS m FROM f_quotes GROUP BY date_trunc('hour', observed_at)) GROUP BY m"""

cte("asof60", """
SELECT d.*, b.bar_close_at, b.close_usd, b.volume, b.idx FROM f_decisions d
ASOF LEFT JOIN (SELECT *, bar_close_at + INTERVAL 2 SECOND AS avail FROM num60) b
 ON d.market_id = b.market_id AND d.cutoff_at >= b.avail""")
ORACLES["asof_bar"] = f"""
SELECT market_id, horizon, {ts('cutoff_at')} AS cutoff_at, COALESCE(idx, 0) AS bars_in_lookback,
  {ts('bar_close_at')} AS bar_close_at, {r('close_usd')} AS close_usd, {r('volume')} AS volume FROM asof60"""

cte("cutoffs", "SELECT DISTINCT cutoff_at FROM f_decisions")
cte("assets", "SELECT cutoff_at, unnest(['BTC', 'ETH']) AS asset FROM cutoffs")
cte("macro_at", """
SELECT c.cutoff_at, m.series_id, m.record_id, m.value, m.mom_pct, m.available_at
FROM cutoffs c JOIN f_macro m ON m.available_at <= c.cutoff_at AND m.series_id IN ('US_CPI_HEADLINE_SA', 'US_EFFR')
QUALIFY row_number() OVER (PARTITION BY c.cutoff_at, m.series_id
  ORDER BY m.available_at DESC, m.revision_seq DESC, m.reference_period DESC, m.record_id DESC) = 1""")
cte("macro_wide", """
SELECT c.cutoff_at, a.record_id AS cpi_record, a.value AS cpi_level, a.mom_pct AS cpi_mom_pct, a.available_at AS cpi_at,
  b.record_id AS effr_record, b.value AS effr_rate, b.available_at AS effr_at
FROM cutoffs c LEFT JOIN macro_at a ON a.cutoff_at = c.cutoff_at AND a.series_id = 'US_CPI_HEADLINE_SA'
 LEFT JOIN macro_at b ON b.cutoff_at = c.cutoff_at AND b.series_id = 'US_EFFR'""")
ORACLES["asof_macro"] = f"""SELECT {ts('cutoff_at')} AS cutoff_at, cpi_record, {r('cpi_level')} AS cpi_level,
  {r('cpi_mom_pct')} AS cpi_mom_pct, effr_record, {r('effr_rate')} AS effr_rate FROM macro_wide"""

cte("flows", """
SELECT asset_id, session_date, 'etf:' || asset_id || ':' || strftime(session_date, '%Y-%m-%d') AS record_id,
  CASE WHEN total IS NULL OR covered < expected THEN 'PARTIAL' WHEN abs(s - total) < 0.2::DOUBLE THEN 'RECONCILED'
       ELSE 'DISPUTED' END AS status,
  CASE WHEN total IS NULL OR covered < expected THEN s ELSE total END * 1e6::DOUBLE AS flow_usd,
  covered AS covered_funds, expected AS expected_funds, covered / expected::DOUBLE AS coverage_ratio,
  CAST(session_date AS TIMESTAMP) + INTERVAL 24 HOUR AS available_at
FROM (SELECT asset_id, session_date, COALESCE(sum(TRY_CAST(value_text AS DOUBLE)), 0) AS s,
        count(TRY_CAST(value_text AS DOUBLE)) AS covered, count(*) AS expected,
        max(TRY_CAST(total_text AS DOUBLE)) AS total FROM f_etf_cells GROUP BY 1, 2)""")
cte("etf_at", """
SELECT a.cutoff_at, a.asset, f.record_id, f.session_date, f.flow_usd, f.coverage_ratio, f.status, f.available_at
FROM assets a ASOF LEFT JOIN flows f ON a.asset = f.asset_id AND a.cutoff_at >= f.available_at""")
ORACLES["etf_reconcile"] = f"""
SELECT asset_id, strftime(session_date, '%Y-%m-%d') AS session_date, status, {r('flow_usd', 2)} AS flow_usd,
  covered_funds, expected_funds, {r('coverage_ratio', 2)} AS coverage_ratio, status = 'RECONCILED' AS is_complete,
  {ts('available_at')} AS available_at FROM flows"""
ORACLES["asof_etf"] = f"""
SELECT asset, {ts('cutoff_at')} AS cutoff_at, record_id, strftime(session_date, '%Y-%m-%d') AS session_date,
  {r('flow_usd', 2)} AS flow_usd, {r('coverage_ratio', 2)} AS coverage_ratio, status FROM etf_at"""

ORACLES["macro_mom_yoy"] = f"""SELECT series_id, CAST(revision_seq AS BIGINT) AS revision_seq, reference_period, record_id,
  {r('value')} AS value, {r('mom_pct')} AS mom_pct, {r('yoy_pct')} AS yoy_pct FROM f_macro"""
cte("vintage", """SELECT * FROM f_macro QUALIFY row_number() OVER (PARTITION BY series_id, reference_period
  ORDER BY revision_seq DESC, available_at DESC, record_id DESC) = 1""")
ORACLES["rates_bps_slope"] = f"""
SELECT c.series_id, c.reference_period, {r('c.change_bps')} AS change_bps, {r('s.slope')} AS slope_bps FROM
 (SELECT series_id, reference_period, (value - lag(value) OVER (PARTITION BY series_id ORDER BY reference_period)) * 100 AS change_bps
  FROM vintage WHERE series_id IN ('US_EFFR', 'US_UST_2Y', 'US_UST_10Y')) c
 JOIN (SELECT reference_period, (max(value) FILTER (series_id = 'US_UST_10Y') - max(value) FILTER (series_id = 'US_UST_2Y')) * 100 AS slope
       FROM vintage WHERE series_id IN ('US_UST_2Y', 'US_UST_10Y') GROUP BY 1) s ON c.reference_period = s.reference_period"""
ORACLES["superseded_anti"] = """
SELECT record_id, series_id, reference_period, CAST(revision_seq AS BIGINT) AS revision_seq FROM f_macro
QUALIFY row_number() OVER (PARTITION BY series_id, reference_period ORDER BY revision_seq DESC) = 1"""

# ---- indicators: one recursion over the row number, all smoothers at once ------------------
cte("ind_in", """
SELECT *, close_usd - p AS ch, greatest(high_usd - low_usd, abs(high_usd - p), abs(low_usd - p)) AS tr, ln(close_usd / p) AS lr,
  avg(close_usd) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS a12,
  avg(close_usd) OVER (w ROWS BETWEEN 25 PRECEDING AND CURRENT ROW) AS a26,
  avg(close_usd) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS a50,
  avg(close_usd) OVER (w ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS a200,
  avg(close_usd) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m20,
  stddev_pop(close_usd) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s20
FROM (SELECT *, lag(close_usd) OVER (PARTITION BY market_id ORDER BY idx) AS p FROM num60)
WINDOW w AS (PARTITION BY market_id ORDER BY idx)""")
cte("ind_seed", """
SELECT *, avg(greatest(ch, 0)) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS g14,
  avg(greatest(-ch, 0)) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS l14,
  avg(tr) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS t14
FROM ind_in WINDOW w AS (PARTITION BY market_id ORDER BY idx)""")


def ema(n, prev, name, seed, first=None):
    k = f"(2.0::DOUBLE / {n + 1})"
    at = first or n
    return (f"CASE WHEN b.idx < {at} THEN NULL WHEN b.idx = {at} THEN b.{seed}"
            f" ELSE s.{prev} + {k} * (b.close_usd - s.{prev}) END AS {name}")


def wilder(x, prev, seed):
    return (f"CASE WHEN b.idx < 15 THEN NULL WHEN b.idx = 15 THEN b.{seed}"
            f" ELSE (s.{prev} * 13 + {x}) / 14 END AS {prev}")


cte("ind_rec", f"""
SELECT market_id, idx, CAST(NULL AS DOUBLE) AS e12, CAST(NULL AS DOUBLE) AS e26, CAST(NULL AS DOUBLE) AS e50,
  CAST(NULL AS DOUBLE) AS e200, CAST(NULL AS DOUBLE) AS f12, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS l,
  CAST(NULL AS DOUBLE) AS atr, CAST(0 AS DOUBLE) AS v FROM ind_seed WHERE idx = 1
UNION ALL
SELECT b.market_id, b.idx, {ema(12, 'e12', 'e12', 'a12')}, {ema(26, 'e26', 'e26', 'a26')},
  {ema(50, 'e50', 'e50', 'a50')}, {ema(200, 'e200', 'e200', 'a200')}, {ema(12, 'f12', 'f12', 'a12', 26)},
  {wilder('greatest(b.ch, 0)', 'g', 'g14')}, {wilder('greatest(-b.ch, 0)', 'l', 'l14')}, {wilder('b.tr', 'atr', 't14')},
  0.94::DOUBLE * s.v + (1 - 0.94::DOUBLE) * b.lr * b.lr AS v
FROM ind_rec s JOIN ind_seed b ON b.market_id = s.market_id AND b.idx = s.idx + 1""")
cte("macd_in", "SELECT market_id, idx, f12 - e26 AS macd FROM ind_rec")
cte("macd_seed", """SELECT *, avg(macd) OVER (PARTITION BY market_id ORDER BY idx ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS m9
FROM macd_in WHERE idx >= 26""")
cte("macd_rec", """
SELECT market_id, idx, macd, m9 AS sig FROM macd_seed WHERE idx = 34
UNION ALL SELECT b.market_id, b.idx, b.macd, s.sig * 0.8::DOUBLE + b.macd * 0.2::DOUBLE
FROM macd_rec s JOIN macd_seed b ON b.market_id = s.market_id AND b.idx = s.idx + 1""")
cte("ind60", """
SELECT b.market_id, b.bar_close_at, b.idx, b.close_usd, b.volume,
  CASE WHEN b.idx >= 15 THEN CASE WHEN g + l <> 0 THEN 100 * g / (g + l) ELSE 0 END END AS tech_rsi_14,
  CASE WHEN b.idx >= 35 THEN m.macd END AS tech_macd, CASE WHEN b.idx >= 35 THEN m.sig END AS tech_macd_signal,
  CASE WHEN b.idx >= 35 THEN m.macd - m.sig END AS tech_macd_hist,
  CASE WHEN b.idx >= 20 THEN m20 + 2 * s20 END AS tech_bb_upper, CASE WHEN b.idx >= 20 THEN m20 END AS tech_bb_middle,
  CASE WHEN b.idx >= 20 THEN m20 - 2 * s20 END AS tech_bb_lower,
  CASE WHEN b.idx >= 20 THEN CASE WHEN s20 > 0 THEN (b.close_usd - (m20 - 2 * s20)) / (4 * s20) ELSE 0.5 END END AS tech_bb_pct_b,
  e12 AS tech_ema_12, e26 AS tech_ema_26, e50 AS tech_ema_50, e200 AS tech_ema_200,
  CASE WHEN b.idx >= 15 THEN atr END AS tech_atr_14,
  CASE WHEN b.idx >= 2 THEN sqrt(v / (1 - pow(0.94::DOUBLE, b.idx - 1))) END AS tech_ewma_volatility
FROM ind_seed b JOIN ind_rec i ON i.market_id = b.market_id AND i.idx = b.idx
LEFT JOIN macd_rec m ON m.market_id = b.market_id AND m.idx = b.idx""")
for name, cols in {
    "tech_rsi": ("tech_rsi_14",), "tech_macd": ("tech_macd", "tech_macd_signal", "tech_macd_hist"),
    "tech_bollinger": ("tech_bb_upper", "tech_bb_middle", "tech_bb_lower", "tech_bb_pct_b"),
    "tech_ema": ("tech_ema_12", "tech_ema_26", "tech_ema_50", "tech_ema_200"),
    "tech_atr": ("tech_atr_14",), "tech_ewma_vol": ("tech_ewma_volatility",),
}.items():
    ORACLES[name] = (f"SELECT market_id, {ts('bar_close_at')} AS bar_close_at, "
                     + ", ".join(f"{r(c, 5)} AS {c}" for c in cols) + " FROM ind60")

# ---- execution data ------------------------------------------------------------------------
DELAY = "CASE horizon WHEN 'scalp_15m' THEN 3 WHEN 'swing_24h' THEN 10 ELSE 60 END"
FORECAST = "CASE horizon WHEN 'scalp_15m' THEN 900 WHEN 'swing_24h' THEN 86400 ELSE 2592000 END"
ORACLES["next_quote"] = f"""
SELECT signal_id, market_id, horizon, {ts('e')} AS eligible_at, {ts('q')} AS quote_at,
  CASE WHEN q IS NOT NULL THEN book_id END AS quote_book, CASE WHEN q IS NOT NULL THEN {r('bid', 8)} END AS quote_bid,
  CASE WHEN q IS NOT NULL THEN {r('ask', 8)} END AS quote_ask, {ts('q + INTERVAL 60 SECOND')} AS fill_until
FROM (SELECT s.signal_id, s.market_id, s.horizon, s.e, CASE WHEN q.observed_at < s.expires_at THEN q.observed_at END AS q,
        q.book_id, q.bid, q.ask
      FROM (SELECT *, issued_at + to_seconds({DELAY}) AS e FROM f_paper_signals) s
      ASOF LEFT JOIN f_quotes q ON s.market_id = q.market_id AND s.e <= q.observed_at)"""
ORACLES["outcome_prices"] = f"""
SELECT d.market_id, d.horizon, {ts('d.cutoff_at')} AS cutoff_at, {ts('d.entry_at')} AS entry_at, {r('d.entry_price')} AS entry_price,
  {ts('x.event_time')} AS exit_at, {r('x.price_usd')} AS exit_price
FROM (SELECT s.*, e.event_time AS entry_at, e.price_usd AS entry_price FROM
        (SELECT *, cutoff_at + to_seconds({DELAY}) AS ef, cutoff_at + to_seconds({DELAY}) + to_seconds({FORECAST}) AS xf FROM f_decisions) s
      ASOF LEFT JOIN f_trades e ON s.market_id = e.market_id AND s.ef <= e.event_time) d
ASOF LEFT JOIN f_trades x ON d.market_id = x.market_id AND d.xf <= x.event_time"""
ORACLES["execution_price"] = f"""
SELECT event_id, scenario, side, {r('mid', 12)} AS mid, {r('spread', 12)} AS spread, {r('price', 12)} AS price,
  {r('price * fee', 6)} AS fee_per_unit
FROM (SELECT *, CASE side WHEN 'BUY' THEN (mid + spread / 2) * (1 + imp) ELSE (mid - spread / 2) * (1 - imp) END AS price
  FROM (SELECT event_id, scenario, side, fee, imp, (bid + ask) / 2 AS mid, greatest((ask - bid) * mult, (bid + ask) / 2 * flo) AS spread
    FROM f_quotes, (VALUES ('PRIMARY_CONSERVATIVE', 0.002::DOUBLE, 0.0005::DOUBLE, 1, 0::DOUBLE),
      ('LOW_COST_SENSITIVITY', 0.0002::DOUBLE, 0.0001::DOUBLE, 1, 0::DOUBLE), ('SEVERE_COST', 0.006::DOUBLE, 0.002::DOUBLE, 2, 0.002::DOUBLE)) v(scenario, fee, imp, mult, flo),
      (VALUES ('BUY'), ('SELL')) w(side)))"""
ORACLES["participation_cap"] = f"""
SELECT fill_id, asset, {r('allowed')} AS allowed_notional, {r('least(quantity, depth, allowed / price)')} AS quantity_cap
FROM (SELECT *, greatest(0, preceding_minute_notional * 0.01::DOUBLE - COALESCE(sum(quantity * price) OVER (
  PARTITION BY asset ORDER BY epoch_us("at") RANGE BETWEEN 59999999 PRECEDING AND 1 PRECEDING), 0)) AS allowed FROM f_fills)"""
ORACLES["depth_remaining"] = f"""
SELECT fill_id, {r('''greatest(0, depth - COALESCE(sum(quantity) OVER (PARTITION BY asset, book_id, side ORDER BY "at", fill_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))''')} AS depth_left FROM f_fills"""
ORACLES = {k: sql(v) for k, v in ORACLES.items()}
