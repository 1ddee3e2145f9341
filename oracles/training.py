"""DuckDB text for the training and calibration queries."""

from oracles.fixtures import HZ, cte, pick, sql, ts
from oracles.market import r
from oracles.policy import P4, W

ORACLES: dict[str, str] = {}

ORACLES["target_clock_checks"] = """
SELECT row_id, concat_ws(',', CASE WHEN e < cutoff_at THEN 'entry_before_cutoff' END, CASE WHEN x <= e THEN 'exit_not_after_entry' END,
  CASE WHEN a < x THEN 'available_before_exit' END, CASE WHEN a > TIMESTAMP '2024-01-20 00:00:00' THEN 'immature' END) AS violations
FROM (SELECT *, CASE WHEN row_id % 13 = 0 THEN x - INTERVAL 1 MINUTE ELSE available_at END AS a
  FROM (SELECT *, CASE WHEN row_id % 11 = 0 THEN e ELSE exit_at END AS x
    FROM (SELECT *, CASE WHEN row_id % 7 = 0 THEN cutoff_at - INTERVAL 1 MINUTE ELSE entry_at END AS e FROM f_clocks)))"""
cte("times", "SELECT cutoff_at, row_number() OVER (ORDER BY cutoff_at) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT cutoff_at FROM f_clocks)")
cte("fold_at", """SELECT k AS fold, t.cutoff_at AS s, (SELECT cutoff_at FROM times u WHERE u.i = u.n * (k + 1) // 6) AS e
FROM times t, (SELECT unnest(range(1, 6)) AS k) WHERE t.i = t.n * k // 6""")


def folds(embargo):
    return f"""SELECT row_id, fold, CASE WHEN c.cutoff_at < l AND exit_at < l AND available_at < l THEN 'train'
  WHEN c.cutoff_at >= s AND (e IS NULL OR c.cutoff_at < e) THEN 'validation' END AS role
FROM f_clocks c, (SELECT *, s - INTERVAL {embargo} SECOND AS l FROM fold_at)"""


ORACLES["purged_folds"] = f"SELECT row_id, CAST(fold AS BIGINT) AS fold, role FROM ({folds(3600)}) WHERE role IS NOT NULL"
ORACLES["oof_excluded"] = f"SELECT row_id FROM f_clocks WHERE row_id NOT IN (SELECT row_id FROM ({folds(0)}) WHERE role = 'validation')"
ORACLES["purge_later"] = "SELECT row_id FROM f_clocks WHERE exit_at < TIMESTAMP '2024-01-05' OR entry_at > TIMESTAMP '2024-01-10'"
cte("ord", """SELECT *, row_number() OVER (ORDER BY cutoff_at, row_id) - 1 AS i, count(*) OVER () AS n,
  CAST(floor(count(*) OVER () * 0.50::DOUBLE) AS BIGINT) AS a, CAST(floor(count(*) OVER () * 0.20::DOUBLE) AS BIGINT) AS b,
  CAST(floor(count(*) OVER () * 0.15::DOUBLE) AS BIGINT) AS c FROM f_clocks""")
cte("parts", """SELECT row_id, y, part FROM (SELECT o.*, CASE WHEN i < a THEN 'experts' WHEN i < a + b THEN 'fusion' WHEN i < a + b + c THEN 'calibration' ELSE 'holdout' END AS part,
   (SELECT cutoff_at FROM ord p WHERE p.i = CASE WHEN o.i < o.a THEN o.a WHEN o.i < o.a + o.b THEN o.a + o.b WHEN o.i < o.a + o.b + o.c THEN o.a + o.b + o.c ELSE -1 END) AS lim
  FROM ord o) WHERE lim IS NULL OR (exit_at < lim AND available_at < lim)""")
ORACLES["train_partitions"] = "SELECT row_id, part FROM parts"

cte("part_preds", "SELECT * FROM f_preds WHERE row_id % CASE pillar WHEN 'technical' THEN 5 WHEN 'macro' THEN 6 WHEN 'etf' THEN 7 ELSE 8 END <> 0")
ORACLES["fusion_rows"] = f"""SELECT row_id, CAST(max(y) AS BIGINT) AS y,
  {', '.join(r(f"max(p_{k}) FILTER (pillar = '{p}')") + f' AS {p}_{k}' for p in P4 for k in ('down', 'flat', 'up'))}
FROM part_preds GROUP BY row_id HAVING count(DISTINCT pillar) = 4"""
ORACLES["oof_set_ops"] = """SELECT row_id, CASE WHEN row_id % 6 <> 0 THEN 'common' ELSE 'technical only' END AS kind FROM f_clocks WHERE row_id % 5 <> 0"""


def _outcome():
    from oracles.policy import ORACLES as P
    return P["outcome_labels"]


_out = _outcome()
cte("outcome_rows", "SELECT * FROM (" + _out + ")")
ORACLES["pillar_dataset"] = f"""
SELECT o.market_id, o.horizon, o.cutoff_at, CAST(CASE outcome WHEN 'DOWN' THEN 0 WHEN 'FLAT' THEN 1 ELSE 2 END AS BIGINT) AS y,
  {r('cpi_level')} AS f0, {r('cpi_mom_pct')} AS f1, {r('effr_rate')} AS f2
FROM outcome_rows o JOIN macro_wide m ON {ts('m.cutoff_at')} = o.cutoff_at WHERE outcome IS NOT NULL"""

ORACLES["oof_rows"] = f"""SELECT f.row_id, CAST(fold AS BIGINT) AS fold, CAST(label % 3 AS BIGINT) AS y, TRUE AS proper
FROM ({folds(0)}) f JOIN embeddings e ON e.vec_id = f.row_id WHERE role = 'validation'"""
ORACLES["class_coverage"] = f"""SELECT CAST(fold AS BIGINT) AS fold, count(*) AS n, count(DISTINCT label % 3) AS present, count(DISTINCT label % 3) < 3 AS lacking
FROM ({folds(0)}) f JOIN embeddings e ON e.vec_id = f.row_id WHERE role = 'train' GROUP BY fold"""

EDGE = "CASE " + " ".join(f"WHEN conf >= {i * 0.1!r}::DOUBLE THEN {i}" for i in range(9, 0, -1)) + " ELSE 0 END"


def ece(src, by):
    g = ", ".join(by) + ", " if by else ""
    gb = "GROUP BY " + ", ".join(by) if by else ""
    return f"""SELECT {g}{r('sum(abs(h - c)) / sum(n)')} AS ece, {r('max(abs(h - c) / n)')} AS max_error, {r('sum(s) / sum(n)')} AS brier,
  {r('sum(c) / sum(n)')} AS mean_confidence, {r('sum(h) / sum(n)')} AS accuracy, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT {g}{EDGE} AS bin, count(*) AS n, sum(conf) AS c, sum(CASE WHEN (CASE WHEN d = conf THEN 0 WHEN f = conf THEN 1 ELSE 2 END) = y THEN 1 ELSE 0 END)::DOUBLE AS h,
   sum(pow(d - (y = 0)::INT, 2) + pow(f - (y = 1)::INT, 2) + pow(u - (y = 2)::INT, 2)) AS s
  FROM (SELECT *, greatest(d, f, u) AS conf FROM ({src})) GROUP BY {g}bin) {gb}"""


_p = "SELECT pillar, y, p_down AS d, p_flat AS f, p_up AS u FROM f_preds"
ORACLES["calibration_ece"] = f"{ece(_p, ['pillar'])} UNION ALL SELECT 'all' AS pillar, * FROM ({ece(_p, [])})"
_cols = "e_down / t AS p0, e_flat / t AS p1, e_up / t AS p2"
ORACLES["temperature_grid"] = f"""
SELECT tt AS temperature, {r('avg(-ln(greatest(CASE y WHEN 0 THEN e0 WHEN 1 THEN e1 ELSE e2 END / (e0 + e1 + e2), 1e-12::DOUBLE)))')} AS nll, count(*) AS n
FROM (SELECT y, tt, exp((z0 - m) / tt) AS e0, exp((z1 - m) / tt) AS e1, exp((z2 - m) / tt) AS e2 FROM
  (SELECT y, z_down AS z0, z_flat AS z1, z_up AS z2, greatest(z_down, z_flat, z_up) AS m FROM f_preds0 WHERE pillar = 'technical'),
  (SELECT unnest([0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0, 6.0, 8.0]::DOUBLE[]) AS tt)) GROUP BY tt"""

# ---- the passes of the fits, replayed ------------------------------------------------------
CLS = ("down", "flat", "up")
_PRI = ", ".join("('" + h + "', " + ", ".join(f"{x}::DOUBLE" for x in W[h]) + ")" for h in HZ)
cte("fit_base", f"SELECT * FROM (VALUES {_PRI}) AS v(horizon, b0, b1, b2, b3)")
cte("fit_rows", "SELECT row_id, any_value(f.y) AS y, part, " + pick("row_id", HZ) + " AS horizon, " + ", ".join(
    f"max(ln(greatest(p_{k}, 1e-6::DOUBLE))) FILTER (pillar = '{p}') AS l{i}{k[0]}" for i, p in enumerate(P4) for k in CLS)
    + " FROM f_preds f JOIN parts USING (row_id) GROUP BY row_id, part")
cte("fit_w0", "SELECT horizon, b0 AS w0, b1 AS w1, b2 AS w2, b3 AS w3 FROM fit_base")
for _k in range(3):
    _s = 0.5 / (1 << _k)
    cte(f"fit_try{_k}", f"""SELECT *, 1.0::DOUBLE - (w0 + w1 + w2) AS w3 FROM (SELECT horizon, x * 25 + y * 5 + z AS i, b0, b1, b2, b3,
  c.w0 + b0 * {_s}::DOUBLE * (2 * x / 4.0::DOUBLE - 1) AS w0, c.w1 + b1 * {_s}::DOUBLE * (2 * y / 4.0::DOUBLE - 1) AS w1, c.w2 + b2 * {_s}::DOUBLE * (2 * z / 4.0::DOUBLE - 1) AS w2
  FROM fit_w{_k} c JOIN fit_base USING (horizon), range(5) AS a(x), range(5) AS b(y), range(5) AS d(z))
WHERE """ + " AND ".join((f"w{i}" if i < 3 else "1.0::DOUBLE - (w0 + w1 + w2)") + f" BETWEEN b{i} * 0.5 - 1e-12::DOUBLE AND b{i} * 1.5 + 1e-12::DOUBLE" for i in range(4)))
    _e = ", ".join("exp(" + " + ".join(f"w{i} * l{i}{k[0]}" for i in range(4)) + f") AS e{k[0]}" for k in CLS)
    _pen2 = " + ".join(f"pow(w{i} - b{i}, 2)" for i in range(4))
    cte(f"fit_best{_k}", f"""SELECT horizon, w0, w1, w2, w3 FROM (SELECT horizon, i, w0, w1, w2, w3, round(avg(-ln(greatest(CASE y WHEN 0 THEN ed WHEN 1 THEN ef ELSE eu END / (ed + ef + eu), 1e-12::DOUBLE)))
  + 0.5 * any_value({_pen2}), 12) AS loss FROM (SELECT t.*, y, {_e} FROM fit_rows JOIN fit_try{_k} t USING (horizon) WHERE part = 'fusion') GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY loss, i) = 1""")
    cte(f"fit_w{_k + 1}", f"SELECT c.horizon, " + ", ".join(f"coalesce(b.w{i}, c.w{i}) AS w{i}" for i in range(4)) + f" FROM fit_w{_k} c LEFT JOIN fit_best{_k} b USING (horizon)")
cte("fit_z", "SELECT row_id, r.y, part, horizon, " + ", ".join(" + ".join(f"w{i} * l{i}{k[0]}" for i in range(4)) + f" AS z_{k}" for k in CLS) + " FROM fit_rows r JOIN fit_w3 USING (horizon)")
cte("fit_n", "SELECT horizon, count(*) AS n FROM fit_z WHERE part = 'calibration' GROUP BY horizon")
cte("fit_t0", "SELECT horizon, 0.1::DOUBLE AS low, 10.0::DOUBLE AS high, 1.0::DOUBLE AS best FROM fit_n")
for _k in range(3):
    cte(f"fit_c{_k}", f"""SELECT horizon, low, step, i FROM (SELECT horizon, low, step, i, round(avg(-ln(greatest(CASE y WHEN 0 THEN e0 WHEN 1 THEN e1 ELSE e2 END / (e0 + e1 + e2), 1e-12::DOUBLE))), 12) AS nll
  FROM (SELECT *, exp((z_down - m) / t) AS e0, exp((z_flat - m) / t) AS e1, exp((z_up - m) / t) AS e2 FROM (SELECT z.*, low, step, i, low * pow(step, i) AS t, greatest(z_down, z_flat, z_up) AS m
    FROM fit_z z JOIN (SELECT *, pow(high / low, 0.05::DOUBLE) AS step FROM fit_t{_k}) USING (horizon), range(21) AS g(i) WHERE part = 'calibration')) GROUP BY horizon, low, step, i)
QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY nll, i) = 1""")
    cte(f"fit_t{_k + 1}", f"SELECT horizon, low * pow(step, greatest(0, i - 1)) AS low, low * pow(step, least(20, i + 1)) AS high, low * pow(step, i) AS best FROM fit_c{_k}")
cte("fit_heat", "SELECT w.*, CASE WHEN n >= 5 THEN best ELSE 1.0::DOUBLE END AS temperature FROM fit_w3 w LEFT JOIN fit_n USING (horizon) LEFT JOIN fit_t3 USING (horizon)")
_h = "SELECT horizon, y, e0 / (e0 + e1 + e2) AS d, e1 / (e0 + e1 + e2) AS f, e2 / (e0 + e1 + e2) AS u FROM (SELECT *, " + ", ".join(
    f"exp((z_{k} - greatest(z_down, z_flat, z_up)) / temperature) AS e{i}" for i, k in enumerate(CLS)) + " FROM fit_z JOIN fit_heat USING (horizon) WHERE part = 'holdout')"


B = W["swing_24h"]
_ax = ["(VALUES (0.5::DOUBLE), (1.0::DOUBLE), (1.5::DOUBLE)) " + f"m{i}(k{i})" for i in range(3)]
cte("lattice", f"""SELECT * FROM (SELECT *, 1 - w0 - w1 - w2 AS w3 FROM (SELECT k0 * {B[0]}::DOUBLE AS w0, k1 * {B[1]}::DOUBLE AS w1, k2 * {B[2]}::DOUBLE AS w2 FROM {', '.join(_ax)}))
WHERE w3 BETWEEN 0.5 * {B[3]}::DOUBLE - 1e-12::DOUBLE AND 1.5 * {B[3]}::DOUBLE + 1e-12::DOUBLE""")
cte("lnp", "SELECT row_id, any_value(y) AS y, " + ", ".join(
    f"max(ln(greatest(p_{k}, 1e-6::DOUBLE))) FILTER (pillar = '{p}') AS l{i}{k[0]}" for i, p in enumerate(P4) for k in ("down", "flat", "up")) + " FROM f_preds GROUP BY row_id")
_pool = ", ".join("exp(" + " + ".join(f"w{i} * l{i}{k}" for i in range(4)) + f") AS e{k}" for k in "dfu")
_pen = " + ".join(f"pow(w{i} - {B[i]}::DOUBLE, 2)" for i in range(4))
ORACLES["fusion_weight_grid"] = f"""
SELECT {', '.join(f'{r(f"w{i}")} AS w_{p}' for i, p in enumerate(P4))}, {r('nll')} AS nll, {r(f'nll + 0.5 * ({_pen})')} AS loss
FROM (SELECT w0, w1, w2, w3, avg(-ln(greatest(CASE y WHEN 0 THEN ed WHEN 1 THEN ef ELSE eu END / (ed + ef + eu), 1e-12::DOUBLE))) AS nll
      FROM (SELECT *, {_pool} FROM lnp, lattice) GROUP BY 1, 2, 3, 4)"""
cte("pool_full", f"""SELECT row_id, horizon, ed / (ed + ef + eu) AS d, ef / (ed + ef + eu) AS f, eu / (ed + ef + eu) AS u FROM (
  SELECT l.row_id, horizon, {', '.join("exp(" + " + ".join(f"(CASE horizon WHEN '{HZ[0]}' THEN {W[HZ[0]][i]} WHEN '{HZ[1]}' THEN {W[HZ[1]][i]} ELSE {W[HZ[2]][i]} END)::DOUBLE * l{i}{k}" for i in range(4)) + f") AS e{k}" for k in "dfu")}
  FROM (SELECT *, {pick('row_id', HZ)} AS horizon FROM lnp) l)""")
_gate_src = "SELECT p.part, q.horizon, p.y, d, f, u FROM pool_full q JOIN parts p ON p.row_id = q.row_id"
ORACLES["calibration_gate"] = f"SELECT *, ece <= 0.08 AS passed FROM ({ece(_gate_src, ['part', 'horizon'])})"
ORACLES["fitted_gate"] = f"""SELECT horizon, {', '.join(f'{r(f"w{i}")} AS w_{p}' for i, p in enumerate(P4))}, EXISTS (SELECT 1 FROM fit_rows q WHERE q.horizon = h.horizon AND part = 'fusion') AS fitted,
  {r('temperature')} AS temperature, ece, max_error, brier, mean_confidence, accuracy, n, COALESCE(ece <= 0.08::DOUBLE, FALSE) AS passed
FROM fit_heat h LEFT JOIN ({ece(_h, ['horizon'])}) USING (horizon)"""
ORACLES = {k: sql(v) for k, v in ORACLES.items()}
