"""DuckDB text for the engine tables: named CTEs that a query pulls in by mentioning them."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def sql(body: str) -> str:
    """Prefix the query with every CTE it mentions, directly or through another one."""
    wanted: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                visit(CTES[name])

    visit(body)
    parts = [f"{n}{'' if n not in HEADS else HEADS[n]} AS ({CTES[n]})" for n in CTES if n in wanted]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


HEADS: dict[str, str] = {}

T0 = "TIMESTAMP '2024-01-01 00:00:00'"
MARKETS = ("binance:BTCUSDT", "binance:ETHUSDT", "coinbase:BTC-USD", "coinbase:ETH-USD")
HZ = ("scalp_15m", "swing_24h", "position_30d")


def pick(x, values):
    return f"CASE ({x}) % {len(values)} " + " ".join(
        f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def ts(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


cte("f_trades", f"""
SELECT CAST(event_id AS VARCHAR) AS trade_id, {pick('user_id', MARKETS)} AS market_id,
       100 + value AS price_usd, CAST(1 + event_id % 7 AS DOUBLE) AS size,
       CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, ts AS event_time
FROM events""")

cte("f_decisions", f"""
SELECT market_id, horizon, cutoff_at FROM
 (SELECT DISTINCT date_trunc('hour', ts) + INTERVAL 1 HOUR + INTERVAL 2 SECOND AS cutoff_at FROM events),
 (SELECT unnest([{', '.join(repr(m) for m in MARKETS)}]) AS market_id),
 (SELECT unnest([{', '.join(repr(h) for h in HZ)}]) AS horizon)""")

cte("f_quotes", f"""
SELECT CASE WHEN user_id % 2 = 0 THEN 'BTC' ELSE 'ETH' END AS asset,
       {pick('user_id', MARKETS)} AS market_id, 100 + value AS bid,
       (100 + value) * (1 + 0.0005::DOUBLE * (1 + event_id % 5)) AS ask,
       CAST(1 + event_id % 11 AS DOUBLE) AS bid_size, CAST(1 + event_id % 11 AS DOUBLE) AS ask_size,
       CAST(10000 + 1000 * (event_id % 100) AS DOUBLE) AS preceding_minute_notional,
       CAST(event_id AS VARCHAR) AS book_id, ts AS observed_at,
       ts + to_seconds(event_id % 3) AS available_at, event_id
FROM events WHERE event_type IN ('view', 'click')""")

cte("f_paper_signals", f"""
SELECT event_id AS signal_id, CASE WHEN user_id % 2 = 0 THEN 'BTC' ELSE 'ETH' END AS asset,
       {pick('user_id', MARKETS)} AS market_id, {pick('event_id', HZ)} AS horizon,
       {pick('event_id', ('Strong Buy', 'Buy', 'Neutral', 'Sell', 'Strong Sell'))} AS label,
       ts AS issued_at, ts + INTERVAL 20 MINUTE AS expires_at
FROM events WHERE event_type = 'signup'""")

cte("f_fills", """
SELECT event_id AS fill_id, CASE WHEN user_id % 2 = 0 THEN 'BTC' ELSE 'ETH' END AS asset,
       CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
       CAST(user_id AS VARCHAR) AS book_id, ts AS at,
       CAST(1 + event_id % 4 AS DOUBLE) AS quantity, 100 + value AS price,
       CAST(10000 + 1000 * (event_id % 100) AS DOUBLE) AS preceding_minute_notional,
       CAST(1 + event_id % 11 AS DOUBLE) AS depth
FROM events WHERE event_type = 'purchase'""")

cte("f_macro0", f"""
SELECT series_id, reference_period, revision_seq, arg_min(record_id, record_id) AS record_id,
       arg_min(value, record_id) AS value, arg_min(available_at, record_id) AS available_at
FROM (SELECT o_orderkey AS record_id,
        CASE SUBSTR(o_orderpriority, 1, 1) WHEN '1' THEN 'US_CPI_HEADLINE_SA'
          WHEN '2' THEN 'US_CPI_CORE_SA' WHEN '3' THEN 'US_EFFR' WHEN '4' THEN 'US_UST_2Y'
          ELSE 'US_UST_10Y' END AS series_id,
        strftime(o_orderdate, '%Y-%m') AS reference_period,
        CAST(o_orderkey % 3 AS INTEGER) AS revision_seq, o_totalprice AS value,
        {T0} + to_hours((o_orderkey * 7919) % 720) AS available_at
      FROM orders)
GROUP BY 1, 2, 3""")

cte("f_macro", """
SELECT *,
  CASE WHEN p1 IS NOT NULL AND p1 <> 0 THEN 100.0::DOUBLE * (value / p1 - 1.0::DOUBLE) END AS mom_pct,
  CASE WHEN p12 IS NOT NULL AND p12 <> 0 THEN 100.0::DOUBLE * (value / p12 - 1.0::DOUBLE) END AS yoy_pct
FROM (SELECT *, lag(value, 1) OVER w AS p1, lag(value, 12) OVER w AS p12 FROM f_macro0
      WINDOW w AS (PARTITION BY series_id, revision_seq ORDER BY reference_period))
WHERE value IS NOT NULL""")

cte("f_etf_long", """
SELECT asset_id, fund_no, session_no, ROUND(cents / 1e6::DOUBLE, 1) AS value_m,
       (fund_no + session_no) % 17 = 0 AS missing
FROM (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'BTC' ELSE 'ETH' END AS asset_id,
             l_suppkey % 10 AS fund_no, l_orderkey % 60 AS session_no,
             CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
      FROM lineitem GROUP BY 1, 2, 3)""")

cte("f_etf_cells", """
SELECT c.asset_id, 'F' || c.fund_no AS fund_id, DATE '2023-12-01' + CAST(c.session_no AS INTEGER) AS session_date,
       CASE WHEN c.missing THEN '-' ELSE CAST(c.value_m AS VARCHAR) END AS value_text,
       CASE WHEN c.session_no % 13 = 0 THEN '-'
            ELSE CAST(ROUND(COALESCE(t.present, 0), 1)
                 + CASE WHEN c.session_no % 11 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS VARCHAR)
       END AS total_text
FROM f_etf_long c JOIN (SELECT asset_id, session_no, SUM(value_m) FILTER (NOT missing) AS present
                        FROM f_etf_long GROUP BY 1, 2) t
  ON c.asset_id = t.asset_id AND c.session_no = t.session_no""")

CLEAN = r"regexp_replace(text, '[\x00-\x08\x0B-\x1F\x7F-\x9F\p{Cf}\p{Co}]', '', 'g')"
OBS = f"{T0} + to_minutes((doc_id * 37) % 2880)"
cte("f_news", f"""
SELECT CAST(doc_id AS VARCHAR) AS record_id,
       CASE WHEN doc_id % 5 = 0 THEN 'K' || (doc_id // 10) ELSE 'D' || doc_id END AS source_key,
       doc_id % 10 AS revision,
       CASE WHEN (doc_id // 10) % 2 = 0 THEN 'BTC' ELSE 'ETH' END AS asset,
       source AS publisher, SUBSTR({CLEAN}, 1, 8000) AS title, LENGTH({CLEAN}) > 8000 AS title_truncated, {CLEAN} AS body,
       CASE WHEN lang = 'en' THEN 'English' ELSE lang END AS language,
       CASE n_chars % 6 WHEN 0 THEN 'RUMOR' WHEN 1 THEN 'ANNOUNCED' WHEN 2 THEN 'EFFECTIVE'
         WHEN 3 THEN 'DENIED' WHEN 4 THEN 'CORRECTED' END AS status,
       (n_chars % 201 - 100) / 100.0::DOUBLE AS sentiment,
       CASE WHEN lang = 'en' THEN (doc_id % 101) / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS relevance,
       'E' || (doc_id % 900) AS event_id, CAST(NULL AS TIMESTAMP) AS published_at,
       {OBS} AS source_observed_at, {OBS} + INTERVAL 1 MINUTE AS first_seen_at,
       {OBS} + INTERVAL 2 MINUTE AS available_at
FROM documents""")

cte("f_polls", f"""
SELECT asset, make_timestamp(q * 900000000) AS checked_at,
       (q - epoch_us({T0}) // 900000000) % 29 = 0 AS coverage_capped,
       CASE WHEN (q - epoch_us({T0}) // 900000000) % 53 = 0 THEN 'm0' ELSE 'm1' END AS model_version
FROM (SELECT DISTINCT epoch_us(ts) // 900000000 AS q FROM events), (SELECT unnest(['BTC', 'ETH']) AS asset)""")

cte("f_preds0", " UNION ALL ".join(f"""
SELECT vec_id AS row_id, '{p}' AS pillar, label % 3 AS y, {T0} + to_hours(vec_id) AS cutoff_at,
  CAST(embedding[{3 * i + 1}] AS DOUBLE) * 5 AS z_down, CAST(embedding[{3 * i + 2}] AS DOUBLE) * 5 AS z_flat,
  CAST(embedding[{3 * i + 3}] AS DOUBLE) * 5 AS z_up,
  LEAST(1.0::DOUBLE, ABS(CAST(embedding[{13 + i}] AS DOUBLE)) * 5) AS quality
FROM embeddings""" for i, p in enumerate(("technical", "macro", "etf", "news"))))

cte("f_preds", """
SELECT row_id, pillar, y, cutoff_at, quality, e_d / (e_d + e_f + e_u) AS p_down,
       e_f / (e_d + e_f + e_u) AS p_flat, e_u / (e_d + e_f + e_u) AS p_up
FROM (SELECT *, exp(z_down - GREATEST(z_down, z_flat, z_up)) AS e_d,
             exp(z_flat - GREATEST(z_down, z_flat, z_up)) AS e_f,
             exp(z_up - GREATEST(z_down, z_flat, z_up)) AS e_u FROM f_preds0)""")

cte("f_clocks", f"""
SELECT vec_id AS row_id, CAST(label % 3 AS INTEGER) AS y, {T0} + to_hours(vec_id) AS cutoff_at,
       {T0} + to_hours(vec_id) + INTERVAL 10 SECOND AS entry_at,
       {T0} + to_hours(vec_id) + INTERVAL 10 SECOND + INTERVAL 1 DAY AS exit_at,
       {T0} + to_hours(vec_id) + INTERVAL 12 SECOND + INTERVAL 1 DAY AS available_at
FROM embeddings""")

SCHED = f"{T0} + to_hours(n_nationkey * 29)"
cte("f_calendar", f"""
SELECT n_nationkey AS event_no, {pick('n_nationkey', ('FOMC_DECISION', 'FOMC_MINUTES', 'CPI_RELEASE'))} AS event_type,
       {SCHED} AS scheduled_at,
       CASE WHEN n_nationkey % 5 <> 0 THEN {SCHED} + to_minutes(n_nationkey % 4) END AS first_seen_at
FROM nation""")

CUT = f"{T0} + to_hours(o_orderkey % 720)"
cte("f_ledger", f"""
SELECT 'S' || o_orderkey AS signal_id, {pick('o_custkey', MARKETS)} AS market_id,
       {pick('o_orderkey', HZ)} AS horizon, o_orderkey AS sequence, {CUT} AS cutoff_at,
       {CUT} + INTERVAL 5 SECOND AS issued_at,
       {CUT} + to_seconds(CASE o_orderkey % 3 WHEN 0 THEN 90 WHEN 1 THEN 1200 ELSE 21600 END) AS expires_at,
       CASE o_orderstatus WHEN 'F' THEN 'READY' WHEN 'O' THEN 'ABSTAIN' ELSE 'UNAVAILABLE' END AS status,
       CASE WHEN o_orderstatus = 'F' THEN CASE SUBSTR(o_orderpriority, 1, 1) WHEN '1' THEN 'Strong Buy'
         WHEN '2' THEN 'Buy' WHEN '3' THEN 'Neutral' WHEN '4' THEN 'Sell' ELSE 'Strong Sell' END END AS label,
       CASE WHEN o_orderstatus = 'F' THEN 0.5::DOUBLE + (o_orderkey % 50) / 100.0::DOUBLE END AS confidence,
       o_orderkey % 41 = 0 AS is_replay
FROM orders""")

cte("f_subs", f"""
SELECT c_custkey AS subscription_id, {pick('c_nationkey', MARKETS)} AS market_id,
       {pick('c_custkey', HZ)} AS horizon, 0.6::DOUBLE + (c_custkey % 4) / 20.0::DOUBLE AS min_confidence,
       CASE WHEN c_custkey % 2 = 0 THEN ['Strong Buy', 'Buy', 'Sell', 'Strong Sell']
            ELSE ['Strong Buy', 'Strong Sell'] END AS allowed_labels
FROM customer""")

cte("f_outbox", """
SELECT event_id AS id, event_type, event_type || ':' || user_id || ':' || strftime(ts, '%Y-%m-%d') AS dedupe_key,
       ts AS created_at, CASE WHEN event_id % 3 <> 0 THEN 'PENDING' ELSE 'DISPATCHED' END AS status,
       props AS payload FROM events""")

cte("f_inbox", "SELECT 'alerts' AS consumer_name, event_id FROM events WHERE event_id % 4 = 0")

cte("f_watchlists", f"""
SELECT s_nationkey AS tenant_id, s_suppkey AS id, s_name AS name,
       [{', '.join(repr(m) for m in MARKETS)}][1:1 + s_suppkey % 4] AS markets FROM supplier""")

cte("f_bundles", """
SELECT bundle_id, horizon, mode, generation, CAST(c AS TIMESTAMP) AS created_at,
       CAST(e AS TIMESTAMP) AS expires_at, CAST(rl AS DOUBLE) AS reliability_lower, cal AS is_calibrated
FROM (VALUES ('b_scalp_1', 'scalp_15m', 'FULL', 1, '2023-12-01', '2024-01-10', 0.58, TRUE),
             ('b_scalp_2', 'scalp_15m', 'FULL', 2, '2024-01-01', '2024-02-10', 0.62, TRUE),
             ('b_swing_1', 'swing_24h', 'FULL', 1, '2023-12-01', '2024-01-20', 0.61, TRUE),
             ('b_position_1', 'position_30d', 'FULL', 1, '2023-12-01', '2024-01-25', 0.66, TRUE),
             ('b_position_2', 'position_30d', 'FULL', 2, '2024-01-06', '2024-03-01', 0.66, FALSE))
     AS v(bundle_id, horizon, mode, generation, c, e, rl, cal)""")
