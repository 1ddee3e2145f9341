"""DuckDB text for the news and payload queries."""

from oracles.fixtures import T0, cte, sql, ts
from oracles.market import r

ORACLES: dict[str, str] = {}

ORACLES["news_checks"] = """
SELECT record_id, concat_ws(',', CASE WHEN i % 29 = 0 THEN 'clock' END,
  CASE WHEN i % 23 = 0 THEN 'negative_revision' END, CASE WHEN i % 17 = 0 THEN 'asset' END,
  CASE WHEN i % 19 = 0 THEN 'empty_id' END, CASE WHEN i % 13 = 0 THEN 'status' END,
  CASE WHEN i % 7 = 0 AND abs(sentiment * 3) > 1 THEN 'sentiment' END,
  CASE WHEN i % 11 = 0 AND relevance - 0.5 < 0 THEN 'relevance' END) AS violations
FROM (SELECT *, CAST(record_id AS BIGINT) AS i FROM f_news)"""
ORACLES["news_rank"] = """
SELECT source_key, record_id, revision, row_number() OVER (PARTITION BY source_key
  ORDER BY revision DESC, available_at DESC, record_id DESC) AS rank
FROM f_news WHERE available_at <= TIMESTAMP '2024-01-02 06:00:00'"""
ORACLES["news_append"] = f"""
SELECT record_id, source_key, revision, {ts('available_at')} AS available_at FROM f_news WHERE CAST(record_id AS BIGINT) % 3 <> 0"""

cte("slots", """SELECT DISTINCT CASE WHEN market_id LIKE '%BTC%' THEN 'BTC' ELSE 'ETH' END AS asset, horizon, cutoff_at,
  CASE horizon WHEN 'scalp_15m' THEN 900 WHEN 'swing_24h' THEN 3600 ELSE 86400 END AS short_s,
  CASE horizon WHEN 'scalp_15m' THEN 3600 WHEN 'swing_24h' THEN 86400 ELSE 604800 END AS long_s,
  CASE horizon WHEN 'scalp_15m' THEN 1800 WHEN 'swing_24h' THEN 21600 ELSE 172800 END AS half_s FROM f_decisions""")
cte("versions_at", """
SELECT c.cutoff_at, n.* FROM cutoffs c JOIN (SELECT * EXCLUDE (title) FROM f_news) n ON n.available_at <= c.cutoff_at
QUALIFY row_number() OVER (PARTITION BY c.cutoff_at, n.asset, n.source_key ORDER BY revision DESC, available_at DESC, record_id DESC) = 1""")
cte("visible", """
SELECT s.asset, s.horizon, s.cutoff_at, s.short_s, s.half_s, v.* EXCLUDE (cutoff_at, asset),
  (epoch_us(s.cutoff_at) - epoch_us(COALESCE(v.published_at, v.source_observed_at))) / 1e6::DOUBLE AS age
FROM slots s JOIN versions_at v ON v.cutoff_at = s.cutoff_at AND v.asset = s.asset
WHERE epoch_us(s.cutoff_at) - epoch_us(COALESCE(v.published_at, v.source_observed_at)) BETWEEN 0 AND s.long_s * 1000000::BIGINT""")
ORACLES["asof_news_versions"] = f"""
SELECT asset, horizon, {ts('cutoff_at')} AS cutoff_at, count(*) AS n, CAST(sum(revision) AS BIGINT) AS revisions,
  CAST(sum(CAST(record_id AS BIGINT)) AS BIGINT) AS record_sum, {ts('max(available_at)')} AS newest
FROM visible GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY visible.asset, visible.horizon, visible.cutoff_at")
cte("events_at", """SELECT * FROM visible QUALIFY row_number() OVER (PARTITION BY asset, horizon, cutoff_at, event_id
  ORDER BY available_at DESC, record_id DESC) = 1""")
ORACLES["news_events"] = f"""
SELECT asset, horizon, {ts('cutoff_at')} AS cutoff_at, count(*) AS events, CAST(sum(CAST(record_id AS BIGINT)) AS BIGINT) AS record_sum,
  {r('sum(age)')} AS age_sum FROM events_at e GROUP BY e.asset, e.horizon, e.cutoff_at"""

cte("toks", r"SELECT record_id, regexp_extract_all(lower(body), '[\p{L}\p{N}_]+') AS t FROM f_news")
cte("shing", """SELECT DISTINCT record_id, t[i] || chr(31) || t[i + 1] || chr(31) || t[i + 2] AS s
FROM (SELECT record_id, t, unnest(range(1, len(t) - 1)) AS i FROM toks WHERE len(t) >= 3)""")
cte("sets", "SELECT record_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS cls FROM shing GROUP BY record_id")
cte("reps", "SELECT cls, min(CAST(record_id AS BIGINT)) AS rec, any_value(n) AS n FROM sets GROUP BY cls")
cte("rep_shing", """SELECT r.rec, r.n, s.s FROM reps r JOIN shing s ON CAST(s.record_id AS BIGINT) = r.rec""")
cte("sim_pairs", """
SELECT a, b, inter / (na + nb - inter)::DOUBLE AS jaccard FROM (
  SELECT x.rec AS a, y.rec AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS inter
  FROM rep_shing x JOIN rep_shing y ON x.s = y.s AND x.rec < y.rec
    AND least(x.n, y.n) >= 0.84::DOUBLE * greatest(x.n, y.n) GROUP BY x.rec, y.rec)
WHERE inter / (na + nb - inter)::DOUBLE >= 0.85::DOUBLE""")
ORACLES["news_neardup_pairs"] = f"SELECT a AS record_a, b AS record_b, {r('jaccard')} AS jaccard FROM sim_pairs"

# edges between events of one slot, then the greedy rule round by round on the events that have any
cte("cls_pairs", """SELECT x.cls AS c1, y.cls AS c2 FROM sim_pairs p JOIN reps x ON x.rec = p.a JOIN reps y ON y.rec = p.b
UNION ALL SELECT y.cls, x.cls FROM sim_pairs p JOIN reps x ON x.rec = p.a JOIN reps y ON y.rec = p.b
UNION ALL SELECT cls, cls FROM reps""")
cte("ev", """SELECT e.asset, e.horizon, e.cutoff_at, e.event_id, e.record_id, e.available_at, e.source_observed_at, e.status, s.cls
FROM events_at e LEFT JOIN sets s ON s.record_id = e.record_id""")
cte("edges", """
SELECT x.asset, x.horizon, x.cutoff_at, x.event_id AS early, y.event_id AS late
FROM ev x JOIN cls_pairs p ON p.c1 = x.cls JOIN ev y ON y.cls = p.c2 AND y.asset = x.asset AND y.horizon = x.horizon
  AND y.cutoff_at = x.cutoff_at AND y.status IS NOT DISTINCT FROM x.status
  AND (x.available_at, x.event_id) < (y.available_at, y.event_id)
  AND abs(epoch_us(x.source_observed_at) - epoch_us(y.source_observed_at)) <= 172800000000""")
cte("greedy", """
SELECT 0 AS step, asset, horizon, cutoff_at, e AS event_id, 0 AS state FROM
  (SELECT asset, horizon, cutoff_at, early AS e FROM edges UNION SELECT asset, horizon, cutoff_at, late FROM edges)
UNION ALL
SELECT g.step + 1, g.asset, g.horizon, g.cutoff_at, g.event_id, CASE WHEN g.state <> 0 THEN g.state
    WHEN max(CASE WHEN p.state = 1 THEN 1 ELSE 0 END) = 1 THEN 2
    WHEN max(CASE WHEN p.state = 0 THEN 1 ELSE 0 END) = 1 THEN 0 ELSE 1 END
FROM greedy g LEFT JOIN edges d ON d.asset = g.asset AND d.horizon = g.horizon AND d.cutoff_at = g.cutoff_at AND d.late = g.event_id
  LEFT JOIN greedy p ON p.asset = d.asset AND p.horizon = d.horizon AND p.cutoff_at = d.cutoff_at AND p.event_id = d.early
WHERE g.step < 40 AND EXISTS (SELECT 1 FROM greedy q WHERE q.state = 0)
GROUP BY g.step, g.asset, g.horizon, g.cutoff_at, g.event_id, g.state""")
cte("dropped", """SELECT asset, horizon, cutoff_at, event_id FROM greedy WHERE step = (SELECT max(step) FROM greedy) AND state = 2""")
cte("kept", """SELECT e.* FROM events_at e ANTI JOIN dropped d ON e.asset = d.asset AND e.horizon = d.horizon
  AND e.cutoff_at = d.cutoff_at AND e.event_id = d.event_id""")
ORACLES["news_neardup_kept"] = f"""
SELECT e.asset, e.horizon, {ts('e.cutoff_at')} AS cutoff_at, count(*) AS events, count(k.record_id) AS kept,
  CAST(COALESCE(sum(CAST(k.record_id AS BIGINT)), 0) AS BIGINT) AS kept_sum
FROM events_at e LEFT JOIN kept k ON k.asset = e.asset AND k.horizon = e.horizon AND k.cutoff_at = e.cutoff_at AND k.event_id = e.event_id
GROUP BY e.asset, e.horizon, e.cutoff_at"""

cte("gate", """
SELECT s.asset, s.horizon, s.cutoff_at, s.short_s, s.half_s, (epoch_us(s.cutoff_at) - epoch_us(p.checked_at)) / 1e6::DOUBLE AS poll_age,
  s.cutoff_at >= TIMESTAMP '2024-01-01 04:00:00' AND s.cutoff_at < TIMESTAMP '2024-01-25' AS may_news, p.checked_at,
  s.cutoff_at >= TIMESTAMP '2024-01-01 04:00:00' AND s.cutoff_at < TIMESTAMP '2024-01-25' AND COALESCE(NOT p.coverage_capped AND p.model_version = 'm1' AND epoch_us(s.cutoff_at) - epoch_us(p.checked_at) < 3600000000, FALSE) AS open
FROM slots s ASOF LEFT JOIN f_polls p ON p.asset = s.asset AND s.cutoff_at >= p.checked_at""")
cte("kept_w", "SELECT *, relevance * exp(-ln(2::DOUBLE) * age / half_s) AS w FROM kept")
cte("per_pub", """SELECT asset, horizon, cutoff_at, publisher, sum(w) FILTER (w > 0) AS sw, sum(sentiment * w) FILTER (w > 0) AS ssw
FROM kept_w GROUP BY 1, 2, 3, 4""")
cte("pubs", """SELECT asset, horizon, cutoff_at, count(sw) AS np, sum(ssw / sw) AS total FROM per_pub GROUP BY 1, 2, 3""")
cte("counts", """SELECT asset, horizon, cutoff_at, count(*) AS n, count(*) FILTER (age <= short_s) AS ns,
  count(*) FILTER (language <> 'English') AS nx, count(*) FILTER (status = 'RUMOR') AS nr, count(*) FILTER (status = 'CORRECTED') AS nc, max(available_at) AS newest
FROM kept GROUP BY 1, 2, 3""")
cte("news_block", """
SELECT g.asset, g.horizon, g.cutoff_at, g.open AS news_active, g.may_news, CASE WHEN open THEN greatest(newest, checked_at) END AS newest_at,
  CASE WHEN open THEN COALESCE(nx, 0)::DOUBLE END AS news_non_english_count,
  CASE WHEN open THEN COALESCE(total * least(0.30::DOUBLE, 1 / np::DOUBLE), 0) END AS news_sentiment,
  CASE WHEN open THEN COALESCE(n, 0)::DOUBLE END AS news_event_count, CASE WHEN open THEN COALESCE(ns, 0)::DOUBLE END AS news_short_event_count,
  CASE WHEN open THEN COALESCE(np, 0)::DOUBLE END AS news_publisher_count,
  CASE WHEN open THEN CASE WHEN COALESCE(np, 0) < 4 THEN 1 ELSE 0 END::DOUBLE END AS news_concentrated,
  CASE WHEN open THEN CASE WHEN COALESCE(np, 0) = 0 THEN 0 ELSE least(0.30::DOUBLE, 1 / np::DOUBLE) * np END END AS news_weight_coverage,
  CASE WHEN open THEN COALESCE(nr / n::DOUBLE, 0) END AS news_rumor_share, CASE WHEN open THEN COALESCE(nc / n::DOUBLE, 0) END AS news_correction_share,
  CASE WHEN open THEN poll_age END AS news_poll_age_seconds, CASE WHEN open THEN COALESCE(n, 0) ELSE -1 END AS lineage_size
FROM gate g LEFT JOIN counts c ON c.asset = g.asset AND c.horizon = g.horizon AND c.cutoff_at = g.cutoff_at
LEFT JOIN pubs p ON p.asset = g.asset AND p.horizon = g.horizon AND p.cutoff_at = g.cutoff_at""")
NEWS = ("news_non_english_count", "news_sentiment", "news_event_count", "news_short_event_count", "news_publisher_count",
        "news_concentrated", "news_weight_coverage", "news_rumor_share", "news_correction_share", "news_poll_age_seconds")
ORACLES["news_features"] = (f"SELECT asset, horizon, {ts('cutoff_at')} AS cutoff_at, news_active, "
                            + ", ".join(f"{r(c)} AS {c}" for c in NEWS)
                            + ", CAST(lineage_size AS BIGINT) AS lineage_size FROM news_block")

ORACLES["news_lineage"] = f"""SELECT k.asset, k.horizon, {ts('k.cutoff_at')} AS cutoff_at, k.record_id
FROM kept k JOIN gate g ON g.asset = k.asset AND g.horizon = k.horizon AND g.cutoff_at = k.cutoff_at AND g.open"""

cte("urls", r"""
SELECT page_id, u, regexp_extract(u, '^(https?)://', 1) AS scheme,
  regexp_extract(u, '^https?://([^/?#]*)', 1) AS host, regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS query
FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'ftp://x.org/' || page_id
    WHEN page_id % 11 = 0 THEN replace(url, '://', '://user@')
    WHEN page_id % 13 = 0 THEN regexp_extract(url, '^[^?#]*', 0) || '?b=2&UTM_Source=x&a=&fbclid=1&c' ELSE url END AS u FROM pages)""")
TRACK = "['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid']"
CANON = f"""CASE WHEN scheme <> '' AND host <> '' AND NOT contains(host, '@') THEN
  scheme || '://' || lower(host) || CASE WHEN path = '' THEN '/' ELSE path END ||
  CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_transform(q, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&') ELSE '' END END"""
ORACLES["canonical_url"] = f"""
SELECT page_id, {CANON} AS canonical_url
FROM (SELECT *, list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT list_contains({TRACK}, lower(split_part(p, '=', 1)))) AS q FROM urls)"""

CC = r"regexp_replace(raw, '[\x00-\x08\x0B-\x1F\x7F-\x9F\p{Cf}\p{Co}]', '', 'g')"
ORACLES["clean_title"] = f"""
SELECT doc_id, md5(substr(c, 1, 8000)) AS title_md5, length(substr(c, 1, 8000)) AS chars, length(c) > 8000 AS truncated
FROM (SELECT doc_id, {CC} AS c FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0
  THEN chr(7) || chr(9) || 'a' || text || chr(31) || 'z' || chr(10) ELSE text END AS raw FROM documents))"""

cte("wtok", r"SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM documents")
cte("terms", """SELECT doc_id, unnest(t) AS term FROM wtok
UNION ALL SELECT doc_id, t[i] || ' ' || t[i + 1] FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM wtok WHERE len(t) >= 2)""")
cte("tf", "SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2")
cte("vocab", """SELECT term, row_number() OVER (ORDER BY total DESC, term) - 1 AS rank,
  ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf
FROM (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 20000)""")
HEADS = [(h, c) for h, n in enumerate((3, 2, 2, 5)) for c in range(n)]
_z = ", ".join(f"sum(x * (((rank * 3 + {h * 5 + c * 7}) % 7 - 3) / 10.0::DOUBLE)) / sqrt(sum(x * x)) AS z{i}"
               for i, (h, c) in enumerate(HEADS))
cte("zs", f"SELECT doc_id, {_z} FROM (SELECT t.doc_id, v.rank, (1 + ln(t.tf)) * v.idf AS x FROM tf t JOIN vocab v ON t.term = v.term) GROUP BY doc_id")


def _soft(i, group):
    top = "greatest(" + ", ".join(f"z{j}" for j in group) + ")"
    return f"exp(z{i} - {top}) / (" + " + ".join(f"exp(z{j} - {top})" for j in group) + ")"


_st = "greatest(z7, z8, z9, z10, z11)"
ORACLES["tfidf_score"] = f"""
SELECT doc_id, {r(f"CASE WHEN lang = 'en' THEN {_soft(2, (0, 1, 2))} - {_soft(0, (0, 1, 2))} ELSE 0 END")} AS sentiment,
  {r(f"CASE WHEN lang = 'en' THEN {_soft(4, (3, 4))} ELSE 0 END")} AS relevance_btc,
  {r(f"CASE WHEN lang = 'en' THEN {_soft(6, (5, 6))} ELSE 0 END")} AS relevance_eth,
  CASE WHEN lang = 'en' THEN CASE {_st} WHEN z7 THEN 'RUMOR' WHEN z8 THEN 'ANNOUNCED' WHEN z9 THEN 'EFFECTIVE' WHEN z10 THEN 'DENIED'
    ELSE 'CORRECTED' END END AS status
FROM (SELECT d.doc_id, d.lang, {', '.join(f'COALESCE(z{i}, 0) AS z{i}' for i in range(12))} FROM documents d LEFT JOIN zs ON zs.doc_id = d.doc_id)"""

ORACLES["text_model_gate"] = f"""
SELECT source, lang, a AS annotated_items, h AS holdout_items, {r('s')} AS sentiment_macro_f1, {r('v')} AS relevance_macro_f1,
  a >= 2000 AND h >= 400 AND s >= 0.75::DOUBLE AND v >= 0.85::DOUBLE AND 0.5::DOUBLE + s / 2 >= 0.67::DOUBLE AND source <> 'src3' AS approved
FROM (SELECT source, lang, count(*) * 400 AS a, count(*) * 80 AS h, avg(quality) AS s, 1.0::DOUBLE - avg(toxic) AS v
      FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1, 2)"""
ORACLES["poll_windows"] = f"""
SELECT asset, {ts('e')} AS polled_at, count(DISTINCT record_id) AS records FROM (
  SELECT asset, record_id, make_timestamp((epoch_us(source_observed_at) // 900000000 + k) * 900000000) AS e
  FROM f_news, (VALUES (1), (2)) v(k)) GROUP BY asset, e"""

cte("cpi_rows", """
SELECT series, y, m, y || '-M' || lpad(m::VARCHAR, 2, '0') AS period,
  CASE WHEN (y * 12 + m) % 17 = 0 OR (y * 12 + m) % 19 = 0 THEN NULL ELSE v END AS value
FROM (SELECT CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CUSR0000SA0' WHEN '2' THEN 'CUUR0000SA0L1E' ELSE 'OTHER' END AS series,
        year(o_orderdate) AS y, month(o_orderdate) AS m, arg_min(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1, 2, 3)
WHERE series <> 'OTHER'""")
ORACLES["macro_cpi_ingest"] = f"""
SELECT CASE series WHEN 'CUSR0000SA0' THEN 'US_CPI_HEADLINE_SA' ELSE 'US_CPI_CORE_NSA' END AS series_id, period AS reference_period,
  {r('value')} AS value, {r('100 * (value / p1 - 1)')} AS mom_pct, {r('100 * (value / p12 - 1)')} AS yoy_pct, 'INDEX' AS unit,
  series = 'CUSR0000SA0' AS is_seasonally_adjusted, series || ':' || period AS source_record_key, '2024-01-01 00:00:00.000000' AS available_at
FROM (SELECT *, lag(value) OVER w AS p1, lag(value, 12) OVER w AS p12 FROM cpi_rows WINDOW w AS (PARTITION BY series ORDER BY period))
WHERE value IS NOT NULL"""
ORACLES["macro_h15_ingest"] = f"""
SELECT CASE p WHEN '1' THEN 'US_EFFR' WHEN '2' THEN 'US_UST_2Y' ELSE 'US_UST_10Y' END AS series_id, strftime(d, '%Y-%m-%d') AS reference_period,
  {r('floor(v) / 100')} AS value, 'PERCENT' AS unit,
  CASE p WHEN '1' THEN 'RIFSPFF_N.B' WHEN '2' THEN 'RIFLGFCY02_N.B' ELSE 'RIFLGFCY10_N.B' END || ':' || strftime(d, '%Y-%m-%d') AS source_record_key,
  strftime(d, '%Y-%m') AS payload_id
FROM (SELECT substr(o_orderpriority, 1, 1) AS p, CAST(o_orderdate AS DATE) AS d, arg_min(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1, 2)
WHERE p IN ('1', '2', '3') AND day(d) % 11 <> 0"""

cte("articles", rf"""
SELECT page_id, page_id // 250 AS payload_id, u AS raw_url, c AS url, lower(regexp_extract(url0, '://([^/?#]+)', 1)) AS publisher,
  regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t0,
  CASE WHEN page_id % 37 <> 0 THEN {T0} + to_hours(page_id % 720) END AS seen, count(*) OVER (PARTITION BY page_id // 250) AS n
FROM (SELECT *, {CANON} AS c FROM (SELECT *, list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT list_contains({TRACK}, lower(split_part(p, '=', 1)))) AS q
  FROM (SELECT page_id, html, url AS url0, u, regexp_extract(u, '^(https?)://', 1) AS scheme, regexp_extract(u, '^https?://([^/?#]*)', 1) AS host,
      regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS query
    FROM (SELECT page_id, html, url, CASE WHEN page_id % 31 = 0 THEN 'mailto:' || url ELSE url END AS u FROM pages))))""")
cte("art", r"""SELECT *, regexp_replace(nfc_normalize(t0), '[\x00-\x08\x0B-\x1F\x7F-\x9F\p{Cf}\p{Co}]', '', 'g') AS t FROM articles""")
cte("art_p", """SELECT *, CASE WHEN url IS NULL THEN 'url' WHEN t0 = '' THEN 'title' WHEN seen IS NULL THEN 'seendate'
  WHEN seen > TIMESTAMP '2024-01-25 00:00:00' THEN 'future' ELSE '' END AS problem FROM art""")
ORACLES["news_ingest"] = f"""
SELECT payload_id, CASE WHEN problem = '' THEN sha256('BTC' || chr(10) || url || chr(10) || substr(t, 1, 8000) || chr(10)
    || strftime(seen, '%Y-%m-%dT%H:%M:%S+00:00')) END AS record_id, url, CASE WHEN problem = '' THEN publisher END AS publisher,
  CASE WHEN problem = '' THEN {ts('seen')} END AS source_observed_at, length(t) > 8000 AND problem = '' AS title_truncated,
  n = 250 AND problem = '' AS coverage_capped, problem FROM art_p"""
ORACLES = {k: sql(v) for k, v in ORACLES.items()}
