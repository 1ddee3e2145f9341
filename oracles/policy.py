"""DuckDB text for the policy, signal, ledger and alert queries."""

from oracles.fixtures import HZ, cte, pick, sql, ts
from oracles.market import DELAY, FORECAST, r
from oracles.news import NEWS

ORACLES: dict[str, str] = {}
K = f"market_id, horizon, {ts('cutoff_at')} AS cutoff_at"
P4 = ("technical", "macro", "etf", "news")

cte("rights_src", """SELECT * FROM (VALUES ('bls', TRUE, NULL), ('fed_board', TRUE, NULL), ('gdelt', TRUE, NULL), ('farside', TRUE, NULL),
  ('binance', TRUE, NULL), ('coinbase', FALSE, 'CONSENT_REQUIRED'), ('reddit', FALSE, NULL)) v(source_id, enabled, why)""")
_all = "['COLLECT', 'RETAIN_RAW', 'COMPUTE_FEATURES', 'TRAIN_ML', 'INFER_ML', 'DISTRIBUTE_SIGNAL']"
cte("rights_pol", f"""SELECT source_id, dataset_id, policy_id, CAST(f AS TIMESTAMP) AS f, CAST(t AS TIMESTAMP) AS t, yes, no, rationale
FROM (VALUES ('bls', '*', 'p_bls', '2023-01-01', NULL, {_all}, []::VARCHAR[], ''), ('fed_board', 'default', 'p_fed', '2023-01-01', NULL, {_all}, [], ''),
 ('farside', 'us_spot_etf_flows', 'p_far', '2023-12-15', '2024-01-28 12:00:00', ['COMPUTE_FEATURES'], ['SERVE_DISPLAY'], 'vendor terms'),
 ('binance', 'spot_trades', 'p_bin', '2024-01-05', NULL, ['COLLECT'], ['EXPORT_RAW'], 'venue terms'),
 ('binance', '*', 'p_bin_any', '2023-01-01', '2024-01-20', ['COLLECT'], [], ''),
 ('gdelt', 'article_metadata', 'p_gdelt', '2024-01-01 04:00:00', '2024-01-25', ['COMPUTE_FEATURES'], [], '')) v(source_id, dataset_id, policy_id, f, t, yes, no, rationale)""")


def rights(requests):
    return f"""
SELECT q.*, CASE WHEN NOT COALESCE(s.enabled, FALSE) THEN 'SOURCE_DISABLED: ' || COALESCE(s.why, 'Source ''' || q.source_id || ''' is switched off')
  WHEN p.policy_id IS NULL THEN 'UNAUTHORIZED_UNKNOWN_PERMISSION: none is registered'
  WHEN q.at_ < p.f THEN 'POLICY_NOT_YET_EFFECTIVE: valid from ' || strftime(p.f, '%Y-%m-%dT%H:%M:%S+00:00')
  WHEN q.at_ >= p.t THEN 'POLICY_EXPIRED: valid until ' || strftime(p.t, '%Y-%m-%dT%H:%M:%S+00:00')
  WHEN list_contains(p.yes, q.operation) THEN 'AUTHORIZED'
  ELSE CASE WHEN list_contains(p.no, q.operation) THEN 'OPERATION_EXPLICITLY_DENIED' ELSE 'UNAUTHORIZED_UNKNOWN_PERMISSION' END
    || CASE WHEN p.rationale <> '' THEN ': ' || p.rationale ELSE '' END END AS reason_code,
  CASE WHEN NOT COALESCE(s.enabled, FALSE) THEN 'config_defaults' ELSE COALESCE(p.policy_id, 'missing_policy') END AS policy_id
FROM ({requests}) q LEFT JOIN rights_src s ON s.source_id = q.source_id
LEFT JOIN rights_pol p ON p.source_id = q.source_id AND p.dataset_id IN (q.dataset_id, '*', 'default')
QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY CASE p.dataset_id WHEN q.dataset_id THEN 1 WHEN '*' THEN 2 ELSE 3 END) = 1"""


OPS = ("COLLECT", "RETAIN_RAW", "COMPUTE_FEATURES", "TRAIN_ML", "INFER_ML", "SERVE_DISPLAY", "DISTRIBUTE_SIGNAL", "EXPORT_RAW")
_req = f"""SELECT event_id AS id, {pick('user_id', ('binance', 'coinbase', 'bls', 'farside', 'gdelt', 'reddit', 'fed_board', 'unknown'))} AS source_id,
  {pick('event_id // 8', ('spot_trades', 'us_spot_etf_flows', 'cpi'))} AS dataset_id, {pick('event_id', OPS)} AS operation, ts AS at_ FROM events"""
ORACLES["rights_gate"] = f"SELECT id AS event_id, reason_code = 'AUTHORIZED' AS allowed, reason_code, policy_id FROM ({rights(_req)})"

# ---- snapshot -----------------------------------------------------------------------------
cte("feed_rights", f"""SELECT cutoff_at, bool_or(source_id = 'bls' AND reason_code = 'AUTHORIZED') AS may_macro,
  bool_or(source_id = 'farside' AND reason_code = 'AUTHORIZED') AS may_etf FROM ({rights('''
  SELECT s || strftime(cutoff_at, '%Y%m%d%H') AS id, cutoff_at, s AS source_id, CASE s WHEN 'bls' THEN 'cpi' ELSE 'us_spot_etf_flows' END AS dataset_id,
    'COMPUTE_FEATURES' AS operation, cutoff_at AS at_ FROM (SELECT cutoff_at, unnest(['bls', 'farside']) AS s FROM cutoffs)''')}) GROUP BY 1""")
T60 = ("tech_rsi_14", "tech_macd", "tech_macd_signal", "tech_macd_hist", "tech_bb_upper", "tech_bb_middle", "tech_bb_lower", "tech_bb_pct_b",
       "tech_ema_12", "tech_ema_26", "tech_ema_50", "tech_ema_200", "tech_atr_14", "tech_ewma_volatility")
STOP = "CASE horizon WHEN 'scalp_15m' THEN 10 WHEN 'swing_24h' THEN 60 ELSE 300 END"


def snap(ind, cols, extra=""):
    return f"""
SELECT d.market_id, d.horizon, d.cutoff_at, COALESCE(b.idx, 0) AS bars_in_lookback, b.bar_close_at, {extra}
  {', '.join('b.' + c for c in cols)},
  CASE WHEN may_macro THEN cpi_level END AS macro_cpi_level, CASE WHEN may_macro THEN cpi_mom_pct END AS macro_cpi_mom_pct,
  CASE WHEN may_macro THEN effr_rate END AS macro_effr_rate, CASE WHEN may_etf THEN e.flow_usd END AS etf_net_flow_usd,
  CASE WHEN may_etf THEN e.coverage_ratio END AS etf_coverage_ratio, {', '.join('n.' + c for c in NEWS)},
  COALESCE(b.idx, 0) >= 1 AS technical_active, may_macro AND (cpi_level IS NOT NULL OR effr_rate IS NOT NULL) AS macro_active,
  may_etf AND e.flow_usd IS NOT NULL AS etf_active, n.news_active, n.may_news, may_macro, may_etf,
  greatest(CASE WHEN may_macro THEN cpi_at END, CASE WHEN may_macro THEN effr_at END, CASE WHEN may_etf THEN e.available_at END, n.newest_at,
    b.bar_close_at + INTERVAL 2 SECOND) AS used,
  CASE WHEN may_macro THEN (cpi_level IS NOT NULL)::INT + (effr_rate IS NOT NULL)::INT ELSE 0 END
    + (may_etf AND e.flow_usd IS NOT NULL)::INT + greatest(n.lineage_size, 0) AS lineage_size,
  (epoch_us(d.cutoff_at) - epoch_us(b.bar_close_at)) / 1e6::DOUBLE AS age, {STOP.replace('horizon', 'd.horizon')} AS stop_s
FROM (SELECT *, CASE WHEN market_id LIKE '%BTC%' THEN 'BTC' ELSE 'ETH' END AS asset FROM f_decisions) d
ASOF LEFT JOIN (SELECT *, bar_close_at + INTERVAL 2 SECOND AS avail FROM {ind}) b ON d.market_id = b.market_id AND d.cutoff_at >= b.avail
LEFT JOIN macro_wide m ON m.cutoff_at = d.cutoff_at LEFT JOIN feed_rights f ON f.cutoff_at = d.cutoff_at
LEFT JOIN etf_at e ON e.cutoff_at = d.cutoff_at AND e.asset = d.asset
LEFT JOIN news_block n ON n.asset = d.asset AND n.horizon = d.horizon AND n.cutoff_at = d.cutoff_at"""


MODE = """CASE WHEN technical_active AND macro_active AND etf_active AND news_active THEN 'FULL'
  WHEN technical_active AND macro_active AND NOT etf_active AND news_active THEN 'CORE_NO_ETF'
  WHEN technical_active AND macro_active AND NOT etf_active AND NOT news_active THEN 'TECH_MACRO' END"""
cte("snap60", snap("ind60", T60, "b.close_usd AS tech_close, b.volume AS tech_volume,"))
_two = lambda c: f"CASE WHEN bars_in_lookback >= 2 THEN {c} END" if c in ("tech_close", "tech_volume") else c
_sc = ("tech_close", "tech_volume", *T60, "macro_cpi_level", "macro_cpi_mom_pct", "macro_effr_rate", "etf_net_flow_usd", "etf_coverage_ratio", *NEWS)
ORACLES["feature_snapshot"] = f"""SELECT {K}, bars_in_lookback, {', '.join(f'{r(_two(c))} AS {c}' for c in _sc)},
  {', '.join(f'{p}_active' for p in P4)}, {MODE} AS mode, CAST(lineage_size AS BIGINT) AS lineage_size FROM snap60"""

FRESH = "CASE WHEN age >= stop_s THEN 0 WHEN age <= 60 THEN 1 ELSE pow(2::DOUBLE, -(age - 60) / 3600) END"
cte("qual", f"""SELECT *, {MODE} AS mode,
  CASE WHEN technical_active AND age > stop_s THEN 0::DOUBLE ELSE 1 END AS technical_validity,
  CASE WHEN technical_active THEN least(1, bars_in_lookback / 60::DOUBLE) ELSE 0 END AS technical_completeness,
  CASE WHEN technical_active THEN {FRESH} ELSE 0 END::DOUBLE AS technical_freshness,
  CASE WHEN may_macro THEN 1 ELSE 0 END::DOUBLE AS macro_validity, macro_active::INT::DOUBLE AS macro_completeness, macro_active::INT::DOUBLE AS macro_freshness,
  CASE WHEN may_etf THEN 1 ELSE 0 END::DOUBLE AS etf_validity, CASE WHEN etf_active THEN greatest(0, least(1, etf_coverage_ratio)) ELSE 0 END AS etf_completeness,
  etf_active::INT::DOUBLE AS etf_freshness, may_news::INT::DOUBLE AS news_validity, news_active::INT::DOUBLE AS news_completeness, news_active::INT::DOUBLE AS news_freshness
FROM snap60""")
_qs = [f"{p}_{n}" for p in P4 for n in ("validity", "completeness", "freshness")]
ORACLES["pillar_quality"] = f"SELECT {K}, {', '.join(f'{r(c)} AS {c}' for c in _qs)} FROM qual"
ORACLES["coverage_mode"] = f"""SELECT horizon, {', '.join(f'{p}_active' for p in P4)}, COALESCE(mode, 'UNSUPPORTED') AS mode, mode IS NOT NULL AS full_serves,
  count(*) AS n FROM qual GROUP BY ALL"""
ORACLES["pit_leak_audit"] = f"SELECT count(*) AS n_rows, {ts('max(used)')} AS newest, count(*) FILTER (used > cutoff_at) AS leaks FROM snap60"
ORACLES["schema_compat"] = f"""SELECT {K}, tech_bb_pct_b IS NOT NULL AND macro_cpi_mom_pct IS NOT NULL AND etf_net_flow_usd IS NOT NULL
  AND news_sentiment IS NOT NULL AS compatible FROM snap60"""

# ---- blackout -----------------------------------------------------------------------------
HIT = """c.scheduled_at - INTERVAL 5 MINUTE <= d.cutoff_at AND (c.first_seen_at IS NULL
  OR d.cutoff_at <= greatest(c.scheduled_at, c.first_seen_at) + INTERVAL 10 MINUTE)"""
cte("blackout", f"""SELECT d.cutoff_at, min(event_no) AS event_no, min(event_no) FILTER (first_seen_at IS NOT NULL) AS seen_no
FROM cutoffs d JOIN f_calendar c ON {HIT} GROUP BY 1""")
ORACLES["event_blackout"] = " UNION ALL ".join(f"""
SELECT d.market_id, d.horizon, {ts('d.cutoff_at')} AS cutoff_at, b.{n} IS NOT NULL AS in_blackout,
  b.{n} IS NOT NULL AND d.horizon = 'scalp_15m' AS suppress_publication, CAST(COALESCE(b.{n}, -1) AS BIGINT) AS event_no, c.event_type, '{k}' AS calendar
FROM f_decisions d LEFT JOIN blackout b ON b.cutoff_at = d.cutoff_at LEFT JOIN f_calendar c ON c.event_no = b.{n}"""
    for n, k in (("event_no", "all"), ("seen_no", "seen")))


def fresh(cad, half, stop, x):
    a = "greatest(0, age)"
    return f"""CASE WHEN {a} >= {stop} THEN 'STALE' WHEN {a} <= {cad} THEN 'HEALTHY' ELSE 'LATE' END AS state_{x},
  {r(f"CASE WHEN {a} >= {stop} THEN 0 WHEN {a} <= {cad} THEN 1 ELSE pow(2::DOUBLE, -({a} - {cad}) / {half}) END")} AS factor_{x},
  {a} >= {stop} AS hard_stop_{x}, {r(a)} AS age_s_{x}, {r(f'greatest(0, {a} - {cad})')} AS overdue_s_{x}"""


ORACLES["freshness_decay"] = f"""SELECT {K}, {fresh(600, 3600, 7200, 'f')}, {fresh(60, 600, 1800, 'g')}, age > {STOP} AS tape_stale
FROM (SELECT *, (epoch_us(cutoff_at) - epoch_us(bar_close_at)) / 1e6::DOUBLE AS age FROM asof60)"""
KH = "CASE horizon WHEN 'scalp_15m' THEN 0.25::DOUBLE WHEN 'swing_24h' THEN 0.35::DOUBLE ELSE 0.5::DOUBLE END"
BH = "CASE horizon WHEN 'scalp_15m' THEN 0.001::DOUBLE WHEN 'swing_24h' THEN 0.003::DOUBLE ELSE 0.015::DOUBLE END"


def theta(v, iv=60):
    return f"greatest(0.0005::DOUBLE, {KH} * greatest(0, {v}) * sqrt({FORECAST} / {iv}::DOUBLE), {BH})"


ORACLES["economic_hurdle"] = f"""SELECT market_id, {ts('bar_close_at')} AS bar_close_at, horizon, {r(theta('v'))} AS theta, {r(theta('v', 3600))} AS theta_hourly
FROM (SELECT *, COALESCE(tech_ewma_volatility, -1) AS v FROM ind60), (SELECT unnest([{', '.join(repr(h) for h in HZ)}]) AS horizon)"""
ORACLES["outcome_labels"] = f"""
SELECT {K}, {r('theta')} AS theta, CASE WHEN x > 0 AND e > 0 THEN CASE WHEN ln(x / e) > theta THEN 'UP' WHEN ln(x / e) < -theta THEN 'DOWN' ELSE 'FLAT' END END AS outcome
FROM (SELECT d.*, t.price_usd AS x, {theta('COALESCE(v, 0)')} AS theta FROM
  (SELECT d.*, t.price_usd AS e FROM (SELECT d.*, b.tech_ewma_volatility AS v, d.cutoff_at + to_seconds({DELAY}) AS ef,
      d.cutoff_at + to_seconds({DELAY}) + to_seconds({FORECAST}) AS xf FROM f_decisions d
      ASOF LEFT JOIN (SELECT *, bar_close_at + INTERVAL 2 SECOND AS avail FROM ind60) b ON b.market_id = d.market_id AND d.cutoff_at >= b.avail) d
   ASOF LEFT JOIN f_trades t ON t.market_id = d.market_id AND d.ef <= t.event_time) d
  ASOF LEFT JOIN f_trades t ON t.market_id = d.market_id AND d.xf <= t.event_time)"""

# ---- quality, ladder, fusion over predictions ----------------------------------------------
W = {"scalp_15m": (0.75, 0.05, 0.05, 0.15), "swing_24h": (0.35, 0.20, 0.25, 0.20), "position_30d": (0.25, 0.30, 0.30, 0.15)}


def pri(i, h="horizon"):
    return f"CASE {h} " + " ".join(f"WHEN '{k}' THEN {v[i]}::DOUBLE" for k, v in W.items()) + " END"


cte("wide", f"""SELECT row_id, {pick('row_id', HZ)} AS horizon,
  {', '.join(f"max({c}) FILTER (pillar = '{p}') AS {p}_{n}" for p in P4 for c, n in (('quality', 'q'), ('p_down', 'd'), ('p_flat', 'f'), ('p_up', 'u')))}
FROM f_preds GROUP BY row_id""")
ORACLES["system_quality"] = f"SELECT row_id, {r('least(1, greatest(0, ' + ' + '.join(f'{pri(i)} * {p}_q' for i, p in enumerate(P4)) + '))')} AS q FROM wide"
_n = " + ".join(f"CASE WHEN {p}_q > 0.5 THEN {pri(i)} * {p}_q ELSE 0 END" for i, p in enumerate(P4))
_d = " + ".join(f"CASE WHEN {p}_q > 0.5 THEN {pri(i)} ELSE 0 END" for i, p in enumerate(P4))
ORACLES["mask_quality"] = f"SELECT row_id, {r(f'CASE WHEN ({_d}) > 0 THEN least(1, greatest(0, ({_n}) / ({_d}))) ELSE 0 END')} AS q FROM wide"
ORACLES["probability_checks"] = """
SELECT row_id, pillar, concat_ws(',', CASE WHEN row_id % 13 = 0 THEN 'not_finite' END,
  CASE WHEN NOT (u BETWEEN 0 AND 1) OR row_id % 13 = 0 OR NOT (d BETWEEN 0 AND 1) THEN 'out_of_range' END,
  CASE WHEN row_id % 13 = 0 OR abs(d + p_flat + u - 1) > 1e-5::DOUBLE THEN 'sum' END) AS violations
FROM (SELECT *, CASE WHEN row_id % 9 = 0 THEN p_up + 1e-4::DOUBLE WHEN row_id % 10 = 0 THEN p_up + 5e-6::DOUBLE WHEN row_id % 11 = 0 THEN p_up + 1 ELSE p_up END AS u,
  CASE WHEN row_id % 17 = 0 THEN -p_down ELSE p_down END AS d FROM f_preds)"""


def agree(a, b):
    return " + ".join(f"CASE WHEN {p}_{a} > {p}_f AND {p}_{a} > {p}_{b} THEN 1 ELSE 0 END" for p in P4)


def ladder(src):
    """First rule that holds; src has d, f, u, q, mode, rel, block, cal, sup, au, ad."""
    def strong(a, b, g):
        return f"mode = 'FULL' AND NOT block AND {a} >= 0.75 AND {a} - {b} >= 0.4::DOUBLE AND q >= 0.9::DOUBLE AND COALESCE(rel >= 0.6::DOUBLE, FALSE) AND {g} >= 2"
    rules = [("sup", "UNAVAILABLE", None, None, None, "EVENT_BLACKOUT"),
             ("COALESCE(mode NOT IN ('FULL', 'CORE_NO_ETF', 'TECH_MACRO'), TRUE)", "UNAVAILABLE", None, None, None, "UNSUPPORTED_SOURCE_MASK"),
             ("NOT cal", "UNAVAILABLE", None, None, None, "UNCALIBRATED_COHORT"),
             ("block AND q < 0.75", "UNAVAILABLE", None, None, None, "EVENT_BLACKOUT"),
             (strong("u", "d", "au"), "READY", "Strong Buy", "u", "UP_ABOVE_FROZEN_HURDLE", None),
             (strong("d", "u", "ad"), "READY", "Strong Sell", "d", "DOWN_BELOW_FROZEN_HURDLE", None),
             ("q >= 0.75 AND u >= 0.6::DOUBLE AND u - d >= 0.2::DOUBLE", "READY", "Buy", "u", "UP_ABOVE_FROZEN_HURDLE", None),
             ("q >= 0.75 AND d >= 0.6::DOUBLE AND d - u >= 0.2::DOUBLE", "READY", "Sell", "d", "DOWN_BELOW_FROZEN_HURDLE", None),
             ("q >= 0.75 AND f >= 0.5 AND NOT (u > f AND u > d) AND NOT (d > f AND d > u)", "READY", "Neutral", "f", "FLAT_WITHIN_FROZEN_HURDLE", None)]
    out = []
    for name, k in (("status", 1), ("label", 2), ("confidence", 3), ("confidence_event", 4), ("reason", 5)):
        arms = " ".join(f"WHEN {x[0]} THEN " + ("NULL" if x[k] is None else (x[k] if k == 3 else f"'{x[k]}'")) for x in rules)
        last = {"status": "'ABSTAIN'", "reason": "'LOW_CONVICTION'"}.get(name, "NULL")
        out.append(f"CASE {arms} ELSE {last} END AS {name}")
    return f"SELECT *, {', '.join(out)} FROM ({src})"


_lad = ladder(f"""SELECT row_id, d / t AS d, f / t AS f, u / t AS u, 0.70::DOUBLE + (row_id % 31) / 100::DOUBLE AS q,
  CASE row_id % 9 WHEN 0 THEN 'CORE_NO_ETF' WHEN 1 THEN 'TECH_MACRO' WHEN 2 THEN 'RESEARCH' WHEN 3 THEN NULL ELSE 'FULL' END AS mode,
  CASE WHEN row_id % 6 <> 0 THEN 0.55::DOUBLE + (row_id % 10) / 100::DOUBLE END AS rel, row_id % 7 = 0 AS block, row_id % 11 <> 0 AS cal, row_id % 13 = 0 AS sup, au, ad
 FROM (SELECT *, d + f + u AS t FROM (SELECT row_id, pow(technical_d, 8) AS d, pow(technical_f, 8) AS f, pow(technical_u, 8) AS u, {agree('u', 'd')} AS au, {agree('d', 'u')} AS ad FROM wide))""")
ORACLES["label_ladder"] = f"SELECT row_id, status, label, {r('confidence')} AS confidence, confidence_event, reason FROM ({_lad})"

MODES = {"FULL": (0, 1, 2, 3), "CORE_NO_ETF": (0, 1, 3), "TECH_MACRO": (0, 1), "RESEARCH": (0, 1, 2, 3)}
_rows = ", ".join(f"('{h}', '{m}', '{P4[i]}', {w[i]}::DOUBLE / {sum(w[j] for j in ix)}::DOUBLE)" for h, w in W.items() for m, ix in MODES.items() for i in ix)
cte("base_w", f"SELECT * FROM (VALUES {_rows}) v(horizon, mode, pillar, baseline)")
_gone = "row_id % 17 = 0 AND pillar = 'macro'"
cte("fin", f"""SELECT row_id, pillar, {pick('row_id', HZ)} AS horizon, {pick('row_id // 3', ('FULL', 'CORE_NO_ETF', 'TECH_MACRO'))} AS mode, quality,
  {', '.join(f'CASE WHEN NOT ({_gone}) THEN {c} END AS {c}' for c in ('p_down', 'p_flat', 'p_up'))} FROM f_preds""")
cte("fw", "SELECT f.*, w.baseline * least(1, greatest(0, quality)) AS raw FROM fin f JOIN base_w w ON w.horizon = f.horizon AND w.mode = f.mode AND w.pillar = f.pillar")
cte("fz", f"""SELECT row_id, tot, lost, {', '.join(f'z_{c} / tot / 1.7::DOUBLE AS z_{c}' for c in ('down', 'flat', 'up'))} FROM
 (SELECT row_id, sum(raw) AS tot, max(CASE WHEN p_down IS NULL THEN raw ELSE 0 END) AS lost,
  {', '.join(f'sum(CASE WHEN p_{c} IS NOT NULL THEN raw * ln(greatest(p_{c}, 1e-6::DOUBLE)) ELSE 0 END) AS z_{c}' for c in ('down', 'flat', 'up'))} FROM fw GROUP BY row_id)""")
cte("fused", f"""SELECT row_id, tot, degraded, {', '.join(f'CASE WHEN NOT degraded THEN e_{c} / (e_down + e_flat + e_up) END AS fused_{c}' for c in ('down', 'flat', 'up'))}
FROM (SELECT row_id, tot, tot <= 1e-9::DOUBLE OR lost / tot > 1e-9::DOUBLE AS degraded,
  {', '.join(f'exp(z_{c} - greatest(z_down, z_flat, z_up)) AS e_{c}' for c in ('down', 'flat', 'up'))} FROM fz)""")
ORACLES["fusion_probs"] = f"SELECT row_id, degraded, {', '.join(f'{r(f_)} AS {f_}' for f_ in ('fused_down', 'fused_flat', 'fused_up'))} FROM fused"
ORACLES["fusion_weights"] = f"""
SELECT horizon, mode, pillar, {r('baseline')} AS baseline, {r('w / sum(w) OVER g')} AS weight,
  bool_and(w BETWEEN 0.5 * baseline - 1e-4::DOUBLE AND 1.5 * baseline + 1e-4::DOUBLE) OVER g AS in_bounds
FROM (SELECT b.*, COALESCE(b.baseline * (0.62::DOUBLE + m), b.baseline) AS w FROM base_w b LEFT JOIN
  (SELECT horizon, mode, pillar, avg(quality) AS m FROM fin GROUP BY 1, 2, 3) l ON l.horizon = b.horizon AND l.mode = b.mode AND l.pillar = b.pillar)
WINDOW g AS (PARTITION BY horizon, mode)"""
_pick = lambda which, a: f"CASE {which} WHEN 'DOWN' THEN {a}down WHEN 'FLAT' THEN {a}flat ELSE {a}up END"
cte("attr", f"""SELECT *, raw / tot AS op_weight, ln(greatest({_pick('selected', 'p_')}, 1e-6::DOUBLE)) - ln(greatest({_pick('opposite', 'p_')}, 1e-6::DOUBLE)) AS raw_diff
FROM (SELECT w.*, f.tot, f.selected, f.opposite FROM fw w JOIN (SELECT *, CASE WHEN selected = 'UP' THEN 'DOWN' WHEN selected = 'DOWN' THEN 'UP' WHEN fused_up >= fused_down THEN 'UP' ELSE 'DOWN' END AS opposite
  FROM (SELECT *, CASE WHEN fused_up > fused_flat AND fused_up > fused_down THEN 'UP' WHEN fused_down > fused_flat AND fused_down > fused_up THEN 'DOWN' ELSE 'FLAT' END AS selected
   FROM fused WHERE NOT degraded)) f ON f.row_id = w.row_id WHERE w.p_down IS NOT NULL)""")
cte("contrib", "SELECT *, op_weight * raw_diff / 1.7::DOUBLE AS contribution FROM attr")
ORACLES["logodds_attribution"] = f"""SELECT row_id, pillar, selected, opposite, {r('op_weight')} AS op_weight, {r('raw_diff')} AS raw_diff,
  {r('contribution')} AS contribution, TRUE AS reproduced FROM contrib"""
CODES = {("technical", "UP"): "TECH_MOMENTUM_SUPPORT", ("technical", "DOWN"): "TECH_TREND_SUPPORT", ("etf", "UP"): "ETF_RECENT_FLOW_SUPPORT",
         ("etf", "DOWN"): "ETF_OUTFLOW_PRESSURE", ("macro", "UP"): "MACRO_INFLATION_EASING", ("macro", "DOWN"): "MACRO_RATE_PRESSURE",
         ("news", "UP"): "NEWS_SENTIMENT_BULLISH", ("news", "DOWN"): "NEWS_REGULATORY_HEADWIND"}
_code = "CASE " + " ".join(f"WHEN pillar = '{p}' AND dir = '{d}' THEN '{c}'" for (p, d), c in CODES.items()) + " ELSE upper(pillar) || '_' || dir END"
cte("ranked", """SELECT *, CASE WHEN contribution < 0 THEN opposite ELSE selected END AS dir, min(CASE WHEN contribution < 0 THEN rk END) OVER (PARTITION BY row_id) AS fa
FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(contribution) DESC, pillar) AS rk FROM contrib)""")
ORACLES["explanation_factors"] = " UNION ALL ".join(f"""
SELECT row_id, least(rk, {n}) AS position, pillar, dir AS direction, {_code} AS code, {r('contribution')} AS contribution, CAST({n} AS BIGINT) AS max_factors
FROM ranked WHERE CASE WHEN COALESCE(fa > {n}, FALSE) THEN rk < {n} OR rk = fa ELSE rk <= {n} END""" for n in (4, 2))

# ---- flagship -----------------------------------------------------------------------------
_lx = {"technical": ("0.9 - 1.8 * COALESCE(tech_bb_pct_b, 0)", "0", "-0.9 + 1.8 * COALESCE(tech_bb_pct_b, 0)"),
       "macro": ("0.01 * COALESCE(macro_cpi_mom_pct, 0)", "0.2", "-0.01 * COALESCE(macro_cpi_mom_pct, 0)"),
       "etf": ("-2e-10 * COALESCE(etf_net_flow_usd, 0)", "0.1 * COALESCE(etf_coverage_ratio, 0)", "0.4 + 2e-10 * COALESCE(etf_net_flow_usd, 0)"),
       "news": ("-4 * COALESCE(news_sentiment, 0)", "0.1 + 0.5 * COALESCE(news_rumor_share, 0)", "4 * COALESCE(news_sentiment, 0)")}
cte("ex1", "SELECT *, " + ", ".join(f"exp(({z})::DOUBLE) AS {p}_e{k}" for p, zs in _lx.items() for k, z in zip("dfu", zs))
    + ", " + ", ".join(f"{p}_validity * {p}_completeness * {p}_freshness AS {p}_s" for p in P4) + " FROM qual")
cte("ex2", "SELECT *, " + ", ".join(f"{p}_e{k} / ({p}_ed + {p}_ef + {p}_eu) AS {p}_{k}" for p in P4 for k in "dfu")
    + ", " + ", ".join(f"{pri(i)} * {p}_s AS {p}_raw" for i, p in enumerate(P4)) + " FROM ex1")
_tot = " + ".join(f"{p}_raw" for p in P4)
cte("ex3", f"SELECT *, {_tot} AS q, " + ", ".join("exp((" + " + ".join(f"{p}_raw * ln(greatest({p}_{k}, 1e-6::DOUBLE))" for p in P4) + f") / nullif({_tot}, 0)) AS g{k}" for k in "dfu")
    + f", {agree('u', 'd')} AS au, {agree('d', 'u')} AS ad FROM ex2")
cte("bundle_for", """SELECT c.cutoff_at, b.* FROM cutoffs c JOIN f_bundles b ON b.created_at <= c.cutoff_at
QUALIFY row_number() OVER (PARTITION BY c.cutoff_at, b.horizon ORDER BY generation DESC) = 1""")
_src = """SELECT e.market_id, e.horizon, e.cutoff_at, e.mode, e.q, e.au, e.ad, gd / (gd + gf + gu) AS d, gf / (gd + gf + gu) AS f, gu / (gd + gf + gu) AS u,
  tech_ewma_volatility, b.bundle_id, b.mode AS bmode, b.expires_at AS bexp, b.reliability_lower AS rel, b.is_calibrated AS cal,
  k.event_no IS NOT NULL AS block, k.event_no IS NOT NULL AND e.horizon = 'scalp_15m' AS sup
FROM ex3 e LEFT JOIN bundle_for b ON b.cutoff_at = e.cutoff_at AND b.horizon = e.horizon LEFT JOIN blackout k ON k.cutoff_at = e.cutoff_at"""
cte("laddered", ladder(_src))
cte("final", """SELECT *, CASE WHEN bexp IS NULL OR cutoff_at >= bexp THEN 1 WHEN COALESCE(bmode <> mode, TRUE) THEN 2 WHEN q <= 1e-9::DOUBLE THEN 3 ELSE 0 END AS early FROM laddered""")
_e = lambda c: f"CASE WHEN early = 0 THEN {c} END"
ORACLES["signals"] = f"""
SELECT {K}, CASE WHEN early > 0 THEN 'UNAVAILABLE' ELSE status END AS status, mode, {_e('label')} AS label, {r(_e('confidence'))} AS confidence,
  {_e('confidence_event')} AS confidence_event, CASE early WHEN 1 THEN 'MODEL_APPROVAL_EXPIRED' WHEN 0 THEN reason ELSE 'UNSUPPORTED_SOURCE_MASK' END AS reason,
  {r("CASE WHEN early IN (1, 2) THEN 0 ELSE least(1, greatest(0, q)) END")} AS data_quality, {r(_e('d'))} AS p_down, {r(_e('f'))} AS p_flat, {r(_e('u'))} AS p_up,
  {r(f"CASE WHEN early = 0 THEN {theta('COALESCE(tech_ewma_volatility, 0)')} ELSE 0 END")} AS outcome_hurdle, bundle_id AS model_bundle,
  {ts('cutoff_at')} AS issued_at, {ts("cutoff_at + to_seconds(CASE horizon WHEN 'scalp_15m' THEN 90 WHEN 'swing_24h' THEN 1200 ELSE 21600 END)")} AS expires_at
FROM final"""
ORACLES["active_bundle"] = f"""
SELECT d.horizon, {ts('d.cutoff_at')} AS cutoff_at, b.bundle_id AS model_bundle, b.mode AS bundle_mode
FROM (SELECT DISTINCT horizon, cutoff_at FROM f_decisions) d LEFT JOIN f_bundles b ON b.horizon = d.horizon AND b.created_at <= d.cutoff_at AND d.cutoff_at < b.expires_at
QUALIFY row_number() OVER (PARTITION BY d.horizon, d.cutoff_at ORDER BY b.generation DESC NULLS LAST) = 1"""

# ---- status and publication ------------------------------------------------------------------
_feeds = "(VALUES ('binance', 'spot_trades', 'COLLECT', 120, 3600, 60), ('fed_board', 'h15_yields', 'COLLECT', 604800, 604800, 3600), ('bls', 'cpi', 'COMPUTE_FEATURES', 604800, 604800, 3600), ('farside', 'us_spot_etf_flows', 'COMPUTE_FEATURES', 86400, 86400, 3600)) v(source_id, dataset_id, operation, full_s, fade_s, shown)"
cte("st_req", rights(f"SELECT source_id || strftime(cutoff_at, '%Y%m%d%H') AS id, cutoff_at AS now, v.*, cutoff_at AS at_ FROM cutoffs, {_feeds}"))
cte("st_upd", """SELECT c.cutoff_at AS now, m.cpi_at, m.effr_at, e.available_at AS etf_at, b.bar_close_at + INTERVAL 2 SECOND AS bar_at
FROM cutoffs c JOIN macro_wide m ON m.cutoff_at = c.cutoff_at JOIN etf_at e ON e.cutoff_at = c.cutoff_at AND e.asset = 'BTC'
JOIN asof60 b ON b.cutoff_at = c.cutoff_at AND b.market_id = 'binance:BTCUSDT' AND b.horizon = 'scalp_15m'""")
cte("st", """SELECT r.*, r.reason_code = 'AUTHORIZED' AS ok, CASE source_id WHEN 'binance' THEN bar_at WHEN 'fed_board' THEN effr_at WHEN 'bls' THEN cpi_at ELSE etf_at END AS upd
FROM st_req r JOIN st_upd u ON u.now = r.now""")
_age = "greatest(0, (epoch_us(now) - epoch_us(upd)) / 1e6::DOUBLE)"
_fac = f"CASE WHEN upd IS NULL OR {_age} <= full_s THEN 1 ELSE greatest(0, 1 - ({_age} - full_s) / fade_s) END"
ORACLES["source_status"] = f"""
SELECT {ts('now')} AS now, source_id, dataset_id, CASE WHEN NOT ok THEN CASE WHEN reason_code LIKE '%DISABLED%' THEN 'DISABLED' ELSE 'RIGHTS_BLOCKED' END
    WHEN {_fac} > 0.5 THEN 'HEALTHY' ELSE 'DEGRADED' END AS state,
  {r(f'CASE WHEN ok THEN round({_fac}, 4) ELSE 0 END')} AS freshness_factor, {r(f'CASE WHEN ok THEN round(CASE WHEN upd IS NULL THEN shown ELSE {_age} END, 1) ELSE 0 END')} AS age_seconds,
  CASE WHEN ok THEN {ts('COALESCE(upd, now)')} END AS last_update_at, NOT ok AS is_hard_stop,
  CASE WHEN bool_and(ok) OVER (PARTITION BY now) THEN 'FULL' ELSE 'TECH_MACRO' END AS mode, CASE WHEN bool_and(ok) OVER (PARTITION BY now) THEN 0.98::DOUBLE ELSE 0.75::DOUBLE END AS overall_quality
FROM st"""
cte("pub", """SELECT signal_id, sequence AS n, cutoff_at + to_seconds((sequence % 7) * 300) AS now, cutoff_at, expires_at FROM f_ledger""")
ORACLES["publication_choice"] = """
SELECT signal_id, CASE WHEN reason IN ('OK', 'APPROVED_ROLLBACK') THEN 'CURRENT' ELSE 'UNAVAILABLE' END AS status, reason,
  CASE reason WHEN 'OK' THEN 'c' || n WHEN 'APPROVED_ROLLBACK' THEN 'f' || n END AS prediction, reason = 'APPROVED_ROLLBACK' AS rolled_back
FROM (SELECT *, CASE WHEN NOT cache AND NOT store THEN 'STALE_OR_MISSING_SNAPSHOT' WHEN cache AND n % 19 = 0 THEN 'RIGHTS_BLOCKED'
    WHEN n % 3 <> 0 AND n % 4 <> 0 AND n % 6 <> 5 THEN 'OK' WHEN n % 2 = 0 AND n % 8 <> 0 THEN 'APPROVED_ROLLBACK' ELSE 'NO_VALID_MODEL' END AS reason
  FROM (SELECT *, n % 5 <> 0 AND now < expires_at AS cache, now < cutoff_at + INTERVAL 20 MINUTE AS store FROM pub))"""

# ---- ledger ----------------------------------------------------------------------------------
_led = f"signal_id, sequence, {ts('cutoff_at')} AS cutoff_at, {ts('issued_at')} AS issued_at, {ts('expires_at')} AS expires_at, status, label, {r('confidence')} AS confidence, is_replay"
cte("cur", """SELECT * FROM f_ledger QUALIFY row_number() OVER (PARTITION BY market_id, horizon ORDER BY cutoff_at DESC, sequence DESC, issued_at DESC) = 1""")
ORACLES["current_signal"] = f"SELECT market_id, horizon, {_led} FROM cur"
_ps = "CASE WHEN status = 'READY' AND TIMESTAMP '2024-01-30 23:02:00' >= expires_at THEN 'EXPIRED' ELSE status END"
ORACLES["latest_signal"] = f"SELECT market_id, horizon, signal_id, status, {_ps} AS projected_status, signal_id || '-' || sequence || '-' || {_ps} AS tag FROM cur"
ORACLES["signal_count"] = "SELECT market_id, horizon, count(*) AS n FROM f_ledger GROUP BY 1, 2"
ORACLES["signal_page"] = f"""SELECT market_id, horizon, {_led} FROM (SELECT * FROM f_ledger WHERE market_id = 'coinbase:BTC-USD' AND horizon = 'swing_24h'
  ORDER BY sequence DESC LIMIT 50 OFFSET 100)"""
ORACLES["change_feed"] = """SELECT market_id, horizon, signal_id, COALESCE(lag(signal_id) OVER (PARTITION BY market_id, horizon ORDER BY cutoff_at, sequence), '') AS previous_id FROM f_ledger"""
ORACLES["signal_sequence"] = f"SELECT {K}, row_number() OVER (PARTITION BY market_id, horizon ORDER BY f_decisions.cutoff_at) AS sequence FROM f_decisions"
ORACLES["signal_roundtrip"] = f"""
SELECT signal_id, CASE WHEN sequence % 11 = 0 THEN 'UNAVAILABLE' ELSE status END AS status, CASE WHEN sequence % 13 = 0 THEN 'RESEARCH' ELSE 'FULL' END AS mode,
  CASE WHEN sequence % 7 <> 0 THEN label END AS label, {r('COALESCE(confidence, 0.4)')} AS p_up, {r('(1 - COALESCE(confidence, 0.4)) / 2')} AS p_down,
  'CODE_' || (sequence % 5) AS code, {r('(sequence % 100) / 8.0::DOUBLE')} AS weight FROM f_ledger"""
ORACLES["outbox_pending"] = f"SELECT id, dedupe_key, {ts('created_at')} AS created_at FROM (SELECT * FROM f_outbox WHERE status = 'PENDING' ORDER BY created_at, id LIMIT 50)"
ORACLES["outbox_dedup"] = f"""SELECT dedupe_key, id, event_type, {ts('created_at')} AS created_at, status FROM f_outbox
QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY f_outbox.created_at, id) = 1"""
ORACLES["inbox_anti"] = "SELECT id, dedupe_key FROM f_outbox WHERE id NOT IN (SELECT event_id FROM f_inbox WHERE consumer_name = 'alerts')"
ORACLES["watchlist_view"] = """SELECT w.market_id, w.tenant_id::BIGINT AS tenant_id, w.id, w.name, CAST(w.position AS BIGINT) AS position, c.horizon, c.signal_id, c.label, c.status
FROM (SELECT tenant_id, id, name, unnest(markets) AS market_id, generate_subscripts(markets, 1) - 1 AS position FROM f_watchlists) w LEFT JOIN cur c ON c.market_id = w.market_id"""
ORACLES["tenant_filter"] = "SELECT '3' AS asked_by, tenant_id::BIGINT AS tenant_id, id, name FROM f_watchlists WHERE tenant_id = 3"

# ---- alerts: candidates, then one recursion per subscription --------------------------------------
cte("live", """SELECT *, lag(label) OVER w AS p_label, lag(confidence) OVER w AS p_conf FROM f_ledger
WHERE status = 'READY' AND label IS NOT NULL AND NOT is_replay WINDOW w AS (PARTITION BY market_id, horizon ORDER BY issued_at, sequence)""")
cte("trig", """SELECT * FROM (SELECT *, CASE WHEN p_label IS NULL THEN 'INITIAL_SIGNAL_TRIGGER' WHEN label <> p_label THEN 'LABEL_CHANGED'
  WHEN confidence - p_conf >= 0.10::DOUBLE THEN 'CONFIDENCE_INCREASE_GE_0_10' END AS reason FROM live WHERE issued_at < expires_at) WHERE reason IS NOT NULL""")
cte("cand", """SELECT s.subscription_id, t.*, CASE t.horizon WHEN 'scalp_15m' THEN 900 WHEN 'swing_24h' THEN 14400 ELSE 86400 END * 1000000::BIGINT AS cool, epoch_us(t.issued_at) AS us,
  row_number() OVER (PARTITION BY s.subscription_id ORDER BY t.issued_at, t.sequence) AS rn
FROM trig t JOIN f_subs s ON s.market_id = t.market_id AND s.horizon = t.horizon AND list_contains(s.allowed_labels, t.label) AND t.confidence >= s.min_confidence""")
_go = "(c.us // 86400000000 <> w.day OR w.cnt < 8) AND c.us - w.last_us >= c.cool"
cte("walk", f"""
SELECT subscription_id, rn, TRUE AS sent, us AS last_us, us // 86400000000 AS day, 1 AS cnt FROM cand WHERE rn = 1
UNION ALL
SELECT c.subscription_id, c.rn, {_go}, CASE WHEN {_go} THEN c.us ELSE w.last_us END, c.us // 86400000000,
  CASE WHEN c.us // 86400000000 <> w.day THEN 0 ELSE w.cnt END + CASE WHEN {_go} THEN 1 ELSE 0 END
FROM walk w JOIN cand c ON c.subscription_id = w.subscription_id AND c.rn = w.rn + 1""")
ORACLES["alert_candidates"] = f"SELECT subscription_id, signal_id, label, {r('confidence')} AS confidence, reason FROM cand"
ORACLES["alert_dispatch"] = f"""SELECT c.subscription_id, c.market_id, c.horizon, c.signal_id, c.sequence, c.label, {r('c.confidence')} AS confidence, {ts('c.issued_at')} AS "at", c.reason
FROM cand c JOIN walk w ON w.subscription_id = c.subscription_id AND w.rn = c.rn AND w.sent"""
ORACLES = {k: sql(v) for k, v in ORACLES.items()}
