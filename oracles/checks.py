"""DuckDB text for row checks, source jobs and matrices."""

import unicodedata

import oracles.training  # noqa: F401  (defines outcome_rows)
from oracles.fixtures import sql, ts
from oracles.market import r
from oracles.policy import NEWS, P4, T60, _two

ORACLES: dict[str, str] = {}

ORACLES["trade_checks"] = """SELECT trade_id, concat_ws(',', CASE WHEN i % 7 = 0 THEN 'price_not_positive' END, CASE WHEN i % 5 = 0 THEN 'size_not_positive' END) AS violations
FROM (SELECT *, CAST(trade_id AS BIGINT) AS i FROM f_trades WHERE price_usd > 0)"""
ORACLES["paper_signal_checks"] = """SELECT signal_id, concat_ws(',', CASE WHEN signal_id % 7 = 0 THEN 'asset' END, CASE WHEN signal_id % 5 = 0 THEN 'label' END,
  CASE WHEN signal_id % 11 = 0 THEN 'validity' END) AS violations FROM f_paper_signals"""
ORACLES["scan_bars_window"] = f"""SELECT market_id, {ts('bar_close_at')} AS bar_close_at, {r('open_usd')} AS open_usd, {r('close_usd')} AS close_usd, {r('volume')} AS volume, trade_count
FROM bars60 WHERE market_id = 'coinbase:ETH-USD' AND bar_close_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:30:00'"""
_day = "strftime(session_date, '%Y-%m-%d') AS session_date"
ORACLES["etf_table"] = f"""SELECT asset_id, {_day}, status, {r('flow_usd', 2)} AS flow_usd, covered_funds, n AS expected_funds, {r('covered_funds / n::DOUBLE', 2)} AS coverage_ratio, '' AS violations
FROM flows JOIN (SELECT asset_id, count(DISTINCT fund_no) AS n FROM f_etf_long GROUP BY 1) USING (asset_id)"""
ORACLES["flow_checks"] = f"""SELECT asset_id, {_day}, concat_ws(',', CASE WHEN e <= 0 THEN 'expected_funds' END, CASE WHEN NOT c BETWEEN 0 AND e THEN 'covered_funds' END) AS violations
FROM (SELECT *, CASE WHEN day(session_date) % 5 = 0 THEN expected_funds + 1 ELSE covered_funds END AS c, CASE WHEN day(session_date) % 7 = 0 THEN 0 ELSE expected_funds END AS e FROM flows)"""
ORACLES["poll_window_halves"] = """SELECT asset, record_id, bool_or(CAST(record_id AS BIGINT) % 97 = 0) OVER (PARTITION BY asset) AS coverage_capped
FROM f_news WHERE hour(source_observed_at) >= 12 OR asset = 'BTC'"""
_raw = "text"
for _a in "éüñçóê":
    _raw = f"replace({_raw}, '{_a}', '{unicodedata.normalize('NFD', _a)}')"
ORACLES["nfc_titles"] = rf"""SELECT doc_id, length_grapheme_free AS chars_before, length(c) AS chars_after, md5(substr(regexp_replace(c, '[\x00-\x08\x0B-\x1F\x7F-\x9F\p{{Cf}}\p{{Co}}]', '', 'g'), 1, 8000)) AS title_md5
FROM (SELECT doc_id, length({_raw}) AS length_grapheme_free, nfc_normalize({_raw}) AS c FROM documents)"""

_parts = {"technical": sorted(("tech_close", "tech_volume", *T60)), "macro": ["macro_cpi_level", "macro_cpi_mom_pct", "macro_effr_rate"],
          "etf": ["etf_coverage_ratio", "etf_net_flow_usd"], "news": sorted(NEWS)}
_rows = []
for _p in P4:
    _n = [_two(c) for c in _parts[_p]]
    _first = ", ".join((r(_n[i], 4) if i < len(_n) else "NULL::DOUBLE") + f" AS f{i}" for i in range(3))
    _rows.append(f"""SELECT o.market_id, o.horizon, o.cutoff_at, '{_p}' AS pillar, CAST(CASE outcome WHEN 'DOWN' THEN 0 WHEN 'FLAT' THEN 1 ELSE 2 END AS BIGINT) AS y, {len(_n)} AS size,
  CAST({' + '.join(f'(({c}) IS NOT NULL)::INT' for c in _n)} AS BIGINT) AS present, {r(' + '.join(f'coalesce({c}, 0)' for c in _n), 4)} AS total, {_first}
FROM outcome_rows o JOIN snap60 s ON {ts('s.cutoff_at')} = o.cutoff_at AND s.market_id = o.market_id AND s.horizon = o.horizon WHERE outcome IS NOT NULL""")
ORACLES["pillar_matrices"] = "\nUNION ALL ".join(_rows)
ORACLES = {k: sql(v) for k, v in ORACLES.items()}
