"""Hand-made boundary tables; expected values are written by hand."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import policy
from tidemark.functions.text import canonical_url
from tidemark.operators import bars, calibration, etf, events, macro, neardup, rights, training
from tidemark.operators.asof import asof


def q(spark, sql):
    return spark.sql(sql)


def one(df):
    return df.collect()[0][0]


def test_bars_minute_edges_and_ties(spark):
    t = q(spark, """SELECT * FROM VALUES ('b','m:X',2D,1D,timestamp_micros(59999999)), ('a','m:X',1D,1D,timestamp_micros(59999999)),
        ('c','m:X',5D,2D,timestamp_micros(60000000)), ('d','m:X',4D,1D,timestamp_micros(200000000))
        AS t(trade_id, market_id, price_usd, size, event_time)""")
    got = bars.ohlcv(t).orderBy("bar_close_at").selectExpr("unix_seconds(bar_close_at) c", "open_usd", "close_usd", "trade_count").collect()
    assert [tuple(r) for r in got] == [(60, 1.0, 2.0, 2), (120, 5.0, 5.0, 1), (240, 4.0, 4.0, 1)]


def test_asof_boundary_and_empty_buckets(spark):
    r = q(spark, """SELECT * FROM VALUES ('k', timestamp_micros(1000000), 1, 1), ('k', timestamp_micros(1000000), 2, 2),
        ('k', timestamp_micros(1000001), 3, 3) AS t(k, rt, seq, v)""")
    l = q(spark, """SELECT * FROM VALUES ('k', timestamp_micros(999999)), ('k', timestamp_micros(1000000)), ('k', timestamp_micros(1000001)),
        ('k', timestamp_micros(900000000000)), ('z', timestamp_micros(5)) AS t(k, lt)""")
    back = {(x.k, x.us): x.v for x in asof(l, r, ["k"], "lt", "rt", ["v"], ["seq"]).selectExpr("k", "unix_micros(lt) us", "v").collect()}
    assert back == {("k", 999999): None, ("k", 1000000): 2, ("k", 1000001): 3, ("k", 900000000000): 3, ("z", 5): None}
    fwd = {x.us: x.v for x in asof(l, r, ["k"], "lt", "rt", ["v"], ["seq"], forward=True).where("k = 'k'").selectExpr("unix_micros(lt) us", "v").collect()}
    assert fwd == {999999: 1, 1000000: 1, 1000001: 3, 900000000000: None}


@pytest.mark.parametrize("bucket", [1, 7, 86400])
def test_asof_equals_brute_force_for_any_bucket(spark, bucket):
    rnd = random.Random(bucket)
    right = [(rnd.choice("ab"), rnd.randrange(60), i) for i in range(60)]
    left = [(rnd.choice("ab"), rnd.randrange(-5, 70)) for _ in range(50)]
    r = spark.createDataFrame(right, "k string, s int, v int").withColumn("rt", F.timestamp_seconds("s"))
    l = spark.createDataFrame([(k, s, i) for i, (k, s) in enumerate(left)], "k string, ls int, n int").withColumn("lt", F.timestamp_seconds("ls"))
    for strict in (False, True):
        got = {x.n: x.v for x in asof(l, r, ["k"], "lt", "rt", ["v"], ["v"], bucket_s=bucket, strict=strict).collect()}
        for n, (k, s) in enumerate(left):
            c = [(t, v) for kk, t, v in right if kk == k and (t < s if strict else t <= s)]
            assert got[n] == (max(c)[1] if c else None)


def test_indicators_equal_a_sequential_fold(spark):
    from tidemark.operators.indicators import indicators
    rnd = random.Random(3)
    n, close = 5000, []
    p = 100.0
    for _ in range(n):
        p = max(5.0, p + rnd.uniform(-1, 1))
        close.append(p)
    rows = [("m:X", i, c, c + 1, c - 1, 1.0) for i, c in enumerate(close)]
    b = spark.createDataFrame(rows, "market_id string, i int, close_usd double, high_usd double, low_usd double, volume double") \
        .withColumn("bar_close_at", F.timestamp_seconds(F.col("i") * 60))
    got = {r.i: r for r in indicators(b, ("tech_ema_12", "tech_ema_200", "tech_macd", "tech_macd_signal", "tech_rsi_14", "tech_ewma_volatility")).collect()}

    def ema(x, m, start=0):
        out = [None] * len(x)
        y = sum(x[start:start + m]) / m
        out[start + m - 1] = y
        for i in range(start + m, len(x)):
            y += 2 / (m + 1) * (x[i] - y)
            out[i] = y
        return out
    e12, e200 = ema(close, 12), ema(close, 200)
    fast, slow = ema(close, 12, 14), ema(close, 26)
    macd = [fast[i] - slow[i] for i in range(25, n)]
    sig = ema(macd, 9)
    g = sum(max(0, close[i] - close[i - 1]) for i in range(1, 15)) / 14
    lo = sum(max(0, close[i - 1] - close[i]) for i in range(1, 15)) / 14
    for i in range(15, n):
        g = (13 * g + max(0, close[i] - close[i - 1])) / 14
        lo = (13 * lo + max(0, close[i - 1] - close[i])) / 14
    for i in (11, 199, 2047, 2048, 4095, 4096, n - 1):
        assert got[i].tech_ema_12 == pytest.approx(e12[i], rel=1e-10)
        if i >= 199:
            assert got[i].tech_ema_200 == pytest.approx(e200[i], rel=1e-10)
            assert got[i].tech_macd == pytest.approx(macd[i - 25], abs=1e-9)
            assert got[i].tech_macd_signal == pytest.approx(sig[i - 25], abs=1e-9)
    assert got[198].tech_ema_200 is None and got[13].tech_rsi_14 is None and got[0].tech_ewma_volatility is None
    assert got[n - 1].tech_rsi_14 == pytest.approx(100 * g / (g + lo), rel=1e-9)


def test_freshness_boundaries(spark):
    d = q(spark, "SELECT * FROM VALUES (-5), (3600), (7199), (7200), (10), (11) AS t(a)").withColumn("z", F.timestamp_seconds(F.lit(0)))
    d = d.withColumn("now", F.timestamp_seconds("a"))
    f = policy.freshness("z", "now", 3600.0)
    got = {r.a: (r.f.state, round(r.f.factor, 4)) for r in d.select("a", f.alias("f")).collect()}
    assert got[-5] == ("HEALTHY", 1.0) and got[3600] == ("HEALTHY", 1.0) and got[7200] == ("STALE", 0.0)
    assert got[7199][0] == "LATE" and got[7199][1] == round(2 ** (-3599 / 3600), 4)
    stale = {r.a: r.s for r in d.select("a", policy.tape_stale("z", "now", F.lit("scalp_15m")).alias("s")).collect()}
    assert stale[10] is False and stale[11] is True


LADDER = [
    # p_down, p_flat, p_up, q, mode, rel, block, cal, suppress, agree_up, agree_down → status, label, reason
    ((0.15, 0.10, 0.75, 0.90, "FULL", 0.60, False, True, False, 2, 0), ("READY", "Strong Buy", None)),
    ((0.15, 0.10, 0.75, 0.90, "FULL", 0.59, False, True, False, 2, 0), ("READY", "Buy", None)),
    ((0.15, 0.10, 0.75, 0.90, "FULL", None, False, True, False, 2, 0), ("READY", "Buy", None)),
    ((0.15, 0.10, 0.75, 0.90, "FULL", 0.60, False, True, False, 1, 0), ("READY", "Buy", None)),
    ((0.15, 0.10, 0.75, 0.90, "CORE_NO_ETF", 0.60, False, True, False, 2, 0), ("READY", "Buy", None)),
    ((0.15, 0.10, 0.75, 0.90, "FULL", 0.60, True, True, False, 2, 0), ("READY", "Buy", None)),
    ((0.15, 0.10, 0.75, 0.74, "FULL", 0.60, True, True, False, 2, 0), ("UNAVAILABLE", None, "EVENT_BLACKOUT")),
    ((0.15, 0.10, 0.75, 0.74, "FULL", 0.60, False, True, False, 2, 0), ("ABSTAIN", None, "LOW_CONVICTION")),
    ((0.15, 0.10, 0.75, 0.90, "FULL", 0.60, False, False, False, 2, 0), ("UNAVAILABLE", None, "UNCALIBRATED_COHORT")),
    ((0.15, 0.10, 0.75, 0.90, "RESEARCH", 0.60, False, False, False, 2, 0), ("UNAVAILABLE", None, "UNSUPPORTED_SOURCE_MASK")),
    ((0.15, 0.10, 0.75, 0.90, None, 0.60, False, True, False, 2, 0), ("UNAVAILABLE", None, "UNSUPPORTED_SOURCE_MASK")),
    ((0.15, 0.10, 0.75, 0.90, "RESEARCH", 0.60, False, False, True, 2, 0), ("UNAVAILABLE", None, "EVENT_BLACKOUT")),
    ((0.75, 0.10, 0.15, 0.95, "FULL", 0.70, False, True, False, 0, 2), ("READY", "Strong Sell", None)),
    ((0.60, 0.30, 0.10, 0.75, "TECH_MACRO", None, False, True, False, 0, 0), ("READY", "Sell", None)),
    ((0.25, 0.50, 0.25, 0.75, "TECH_MACRO", None, False, True, False, 0, 0), ("READY", "Neutral", None)),
    ((0.50, 0.50, 0.00, 0.75, "TECH_MACRO", None, False, True, False, 0, 0), ("READY", "Neutral", None)),
    ((0.255, 0.49, 0.255, 0.75, "TECH_MACRO", None, False, True, False, 0, 0), ("ABSTAIN", None, "LOW_CONVICTION")),
]


def test_ladder(spark):
    d = spark.createDataFrame([(i, *x[0]) for i, x in enumerate(LADDER)],
                              "i int, d double, f double, u double, q double, mode string, rel double, block boolean, cal boolean,"
                              " sup boolean, au int, ad int")
    lad = policy.label_ladder(*[F.col(c) for c in ("d", "f", "u", "q", "mode", "rel", "block", "cal", "sup", "au", "ad")])
    got = {r.i: (r.l.status, r.l.label, r.l.reason) for r in d.select("i", lad.alias("l")).collect()}
    assert [got[i] for i in range(len(LADDER))] == [x[1] for x in LADDER]


def test_outcome_is_strict(spark):
    import math
    d = spark.createDataFrame([(100.0, 100.0 * math.e, 1.0), (100.0, 271.9, 1.0), (100.0, 36.7, 1.0), (0.0, 1.0, 1.0)], "e double, x double, t double")
    got = [r[0] for r in d.select(policy.outcome_class(F.col("e"), F.col("x"), F.ln(F.lit(math.e)) * F.col("t"))).collect()]
    assert got[1:] == ["UP", "DOWN", None]


def test_blackout_windows(spark):
    cal = q(spark, """SELECT * FROM VALUES (0, 'CPI_RELEASE', timestamp_seconds(10000), timestamp_seconds(10060)),
        (1, 'FOMC_DECISION', timestamp_seconds(10000), timestamp_seconds(9990)), (2, 'FOMC_MINUTES', timestamp_seconds(500000), NULL)
        AS t(event_no, event_type, scheduled_at, first_seen_at)""")
    at = [9699.999999, 9700, 10660, 10660.000001, 499699, 499700, 9000000]
    d = spark.createDataFrame([(float(a), h) for a in at for h in ("scalp_15m", "swing_24h")], "s double, horizon string") \
        .withColumn("cutoff_at", F.timestamp_micros((F.col("s") * 1e6).cast("bigint")))
    got = {(r.s, r.horizon): (r.in_blackout, r.suppress_publication, r.event_no) for r in events.event_blackout(d, cal).collect()}
    assert got[(9699.999999, "scalp_15m")] == (False, False, None)
    assert got[(9700.0, "scalp_15m")] == (True, True, 0) and got[(9700.0, "swing_24h")] == (True, False, 0)
    assert got[(10660.0, "scalp_15m")][2] == 0 and got[(10660.000001, "scalp_15m")][0] is False
    assert got[(499699.0, "scalp_15m")][0] is False and got[(499700.0, "swing_24h")] == (True, False, 2)
    assert got[(9000000.0, "swing_24h")][2] == 2
    unhealthy = events.event_blackout(d, cal, feed_is_healthy=False)
    assert unhealthy.where("s = 10660.000001 AND in_blackout").count() == 2


def test_rights_time_bounds(spark):
    src = q(spark, "SELECT 'a' source_id, true enabled, CAST(NULL AS STRING) disabled_reason UNION ALL SELECT 'off', false, 'WHY'")
    pol = q(spark, """SELECT 'a' source_id, '*' dataset_id, 'p' policy_id, timestamp_seconds(100) effective_from, timestamp_seconds(200) effective_to,
        map('COLLECT', 'PERMITTED', 'EXPORT_RAW', 'DENIED') entitlements, '' rationale, 1 registered""")
    req = q(spark, """SELECT * FROM VALUES ('a', 99, 'COLLECT'), ('a', 100, 'COLLECT'), ('a', 199, 'COLLECT'), ('a', 200, 'COLLECT'), ('a', 150, 'EXPORT_RAW'),
        ('a', 150, 'TRAIN_ML'), ('off', 150, 'COLLECT'), ('who', 150, 'COLLECT') AS t(source_id, s, operation)""")
    req = req.withColumn("dataset_id", F.lit("d")).withColumn("requested_at", F.timestamp_seconds("s"))
    got = {(r.source_id, r.s, r.operation): r.reason_code.split(":")[0] for r in rights.rights_gate(req, src, pol).collect()}
    assert got == {("a", 99, "COLLECT"): "POLICY_NOT_YET_EFFECTIVE", ("a", 100, "COLLECT"): "AUTHORIZED", ("a", 199, "COLLECT"): "AUTHORIZED",
                   ("a", 200, "COLLECT"): "POLICY_EXPIRED", ("a", 150, "EXPORT_RAW"): "OPERATION_EXPLICITLY_DENIED",
                   ("a", 150, "TRAIN_ML"): "UNAUTHORIZED_UNKNOWN_PERMISSION", ("off", 150, "COLLECT"): "SOURCE_DISABLED",
                   ("who", 150, "COLLECT"): "SOURCE_DISABLED"}


def test_etf_reconciliation(spark):
    def day(n, cells, total):
        return [("BTC", f"2024-01-{n:02d}", f"F{i}", c, total) for i, c in enumerate(cells)]
    rows = (day(1, ["1.0", "1,000.5"], "1001.5") + day(2, ["1.0", "2.0"], "3.199") + day(3, ["1.0", "2.0"], "3.2001") + day(4, ["1.0", "-"], "1.0")
            + day(5, ["1.0", "2.0"], "-") + day(6, ["nan", "2.0"], "2.0") + day(7, ["5.0", None], "5.0"))
    d = spark.createDataFrame(rows, "asset_id string, day string, fund_id string, value_text string, total_text string") \
        .withColumn("session_date", F.to_date("day"))
    got = {r.session_date.day: (r.status, r.flow_usd, r.covered_funds) for r in etf.reconcile(d).collect()}
    assert got[1] == ("RECONCILED", 1001.5e6, 2) and got[2][0] == "RECONCILED" and got[3] == ("DISPUTED", 3.2001e6, 2)
    assert got[4] == ("PARTIAL", 1e6, 1) and got[5] == ("PARTIAL", 3e6, 2) and got[6][0] == "DISPUTED" and got[7] == ("RECONCILED", 5e6, 1)


def test_etf_table_headers_and_dates(spark):
    from tidemark.sources.payloads import etf_table_cells
    rows = [("BTC", 1, 0, ["Date", "AAA", "", "BBB", "Total"]), ("BTC", 1, 1, ["04 Sep 2026", "1.0", "x", "2.0", "3.0"]),
            ("BTC", 1, 2, ["2026-09-07", "1.0"]), ("BTC", 1, 3, ["Average", "1.0", "", "2.0", "3.0"])]
    d = spark.createDataFrame(rows, "asset_id string, table_id int, row_no int, cells array<string>")
    got = {(str(r.session_date), r.fund_id): (r.value_text, r.total_text) for r in etf_table_cells(d).collect()}
    assert got == {("2026-09-04", "AAA"): ("1.0", "3.0"), ("2026-09-04", "BBB"): ("2.0", "3.0"), ("2026-09-07", "AAA"): ("1.0", None),
                   ("2026-09-07", "BBB"): (None, None)}


def test_macro_changes(spark):
    rows = [(f"2024-{m:02d}", None if m == 3 else (0.0 if m == 5 else float(m))) for m in range(1, 13)] + [("2025-01", 2.0)]
    d = spark.createDataFrame(rows, "reference_period string, value double").withColumn("s", F.lit("x"))
    got = {r.reference_period: (r.mom_pct, r.yoy_pct) for r in macro.with_changes(d, ["s"], ["reference_period"]).collect()}
    assert "2024-03" not in got and got["2024-04"] == (None, None) and got["2024-06"] == (None, None)
    assert got["2024-02"] == (100.0, None) and got["2025-01"][1] == 100.0


def test_folds_and_partitions(spark):
    def clocks(n):
        return spark.range(n).selectExpr("id AS row_id", "timestamp_seconds(id * 100) AS cutoff_at", "timestamp_seconds(id * 100 + 1) AS entry_at",
                                         "timestamp_seconds(id * 100 + 100) AS exit_at", "timestamp_seconds(id * 100 + 100) AS available_at")
    with pytest.raises(ValueError):
        training.purged_folds(clocks(5))
    got = {(r.row_id, r.fold, r.role) for r in training.purged_folds(clocks(12)).collect()}
    assert {x for x in got if x[1] == 1} == {(0, 1, "train"), (2, 1, "validation"), (3, 1, "validation")}  # row 1 ends at the start
    assert {x[0] for x in got if x[1] == 5 and x[2] == "train"} == set(range(9))
    parts = {r.row_id: r.part for r in training.train_partitions(clocks(20)).collect()}
    assert [k for k, v in parts.items() if v == "holdout"] == [17, 18, 19] and 9 not in parts and 8 in parts and 13 not in parts


def test_calibration_edges(spark):
    rows = [(0.0, 0.0, 1.0, 2), (0.3, 0.3, 0.4, 2), (0.5, 0.5, 0.0, 1), (0.2, 0.2, 0.6, 0)]
    d = spark.createDataFrame(rows, "p_down double, p_flat double, p_up double, y int")
    bins = [r[0] for r in d.select(calibration.confidence_bin(F.greatest("p_down", "p_flat", "p_up"))).collect()]
    assert bins == [9, 4, 5, 5]  # 0.6 lies below the double nearest to 6·0.1
    r = calibration.calibration_report(d).first()
    assert r.n == 4 and r.accuracy == 0.5 and r.mean_confidence == pytest.approx(0.625)
    assert calibration.calibration_report(d.limit(0)).first().ece == 0.0


def test_temperature_and_weights_fit(spark):
    rnd = random.Random(1)
    rows = []
    for _ in range(400):
        z = [rnd.gauss(0, 2) for _ in range(3)]
        w = [2.718281828 ** (v / 2.5) for v in z]
        rows.append((*z, rnd.choices(range(3), w)[0]))
    d = spark.createDataFrame(rows, "z_down double, z_flat double, z_up double, y int")
    few = d.limit(4).withColumn("cohort", F.lit("few"))
    t = dict(map(tuple, calibration.fit_temperatures(d.withColumn("cohort", F.lit("all")).unionByName(few), "cohort").collect()))
    assert 1.8 < t["all"] < 3.5 and t["few"] == 1.0
    curve = {r.temperature: r.nll for r in calibration.temperature_curve(d, [t["all"], t["all"] * 1.1, t["all"] / 1.1]).collect()}
    assert min(curve, key=curve.get) == t["all"]


def test_canonical_url(spark):
    cases = {"http://A.com": "http://a.com/", "https://a.com/P?utm_source=x&b=1#f": "https://a.com/P?b=1", "ftp://a.com/": None,
             "https://u@a.com/": None, "https://a.com/?q": "https://a.com/?q=", "https://a.com?GCLID=1": "https://a.com/", "nope": None}
    d = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.c for r in d.select("u", canonical_url("u").alias("c")).collect()} == cases


# ---- near-duplicates against the sequential rule ------------------------------------------
def brute(events, limit=512):
    def sh(t):
        w = t.split()
        return {tuple(w[i:i + 3]) for i in range(len(w) - 2)}
    kept, over = [], False
    for e in sorted(events, key=lambda x: (x[2], x[0])):
        s = sh(e[1])
        cand = [k for k in kept if s & k[1]]
        over |= len(cand) > limit
        if not any(abs(e[3] - k[0][3]) <= 172800 and e[4] == k[0][4] and len(s & k[1]) / len(s | k[1]) >= 0.85 for k in cand):
            kept.append((e, s))
    return {k[0][0] for k in kept}, over


def judge(spark, evs, limit=512):
    d = spark.createDataFrame(evs, "event_id string, title string, a long, o long, status string").selectExpr(
        "event_id", "event_id AS record_id", "title", "timestamp_seconds(a) AS available_at", "timestamp_seconds(o) AS source_observed_at", "status", "'s' AS slot")
    classes = neardup.text_classes(d)
    e = d.join(classes.select("record_id", "class_id"), "record_id").drop("title")
    out = neardup.suppress_near_duplicates(e, neardup.similar_pairs(classes), ["slot"])
    over = neardup.over_candidate_limit(out, classes, ["slot"], limit).count() > 0
    return {r.event_id for r in out.where("kept").collect()}, over


def test_near_duplicates_equal_sequential_rule(spark):
    rnd = random.Random(7)
    base = [[f"w{rnd.randrange(400)}" for _ in range(40)] for _ in range(6)]
    evs = []
    for i in range(150):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice((0, 0, 1, 1, 2))):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(30)}"
        t = rnd.randrange(400000)
        evs.append((f"e{i:03d}", " ".join(w), t + rnd.randrange(50000), t, rnd.choice(("RUMOR", "DENIED", None))))
    evs += [("short1", "a b", 1, 1, None), ("short2", "a b", 2, 2, None)]
    assert judge(spark, evs) == (brute(evs)[0], False)


def test_48_hours_and_status(spark):
    t = "a b c d e f g h"
    evs = [("1", t, 0, 0, "RUMOR"), ("2", t, 1, 172800, "RUMOR"), ("3", t, 2, 172801, "RUMOR"), ("4", t, 3, 0, None), ("5", t, 4, 0, None)]
    assert judge(spark, evs)[0] == {"1", "3", "4"}


@pytest.mark.parametrize("n,expected", [(5, False), (6, True)])
def test_candidate_limit(spark, n, expected):
    """With limit 4, the sixth event sees five kept earlier events that share a shingle."""
    evs = [(f"{i}", f"same old start u{i} v{i} w{i} x{i} y{i}", i, i, None) for i in range(n)]
    assert judge(spark, evs, 4)[1] is expected is brute(evs, 4)[1]


def test_pool_weights_move_towards_the_better_pillar_and_stay_in_bounds(spark):
    """The first pillar knows the outcome, the second one errs; a cohort without rows keeps its baseline."""
    import math
    rows = []
    for i in range(90):
        y, row = i % 3, {"cohort": "a", "y": i % 3}
        for p, good in (("p", 0.9), ("q", 0.05), ("r", 1 / 3)):
            for k, c in enumerate(("down", "flat", "up")):
                row[f"ln_{p}_{c}"] = math.log(good if k == y else (1 - good) / 2)
        rows.append(row)
    base = spark.createDataFrame([("a", 0.4, 0.4, 0.2), ("b", 0.5, 0.25, 0.25)], "cohort string, b_p double, b_q double, b_r double")
    got = {r.cohort: r for r in calibration.fit_pool_weights(spark.createDataFrame(rows), base, "cohort", ["p", "q", "r"]).collect()}
    a, b = got["a"], got["b"]
    assert a.fitted and a.w_p > 0.4 > a.w_q and abs(a.w_p + a.w_q + a.w_r - 1) < 1e-9
    assert 0.2 - 1e-9 <= a.w_q and a.w_p <= 0.6 + 1e-9 and 0.1 - 1e-9 <= a.w_r <= 0.3 + 1e-9
    assert (b.w_p, b.w_q, b.w_r, b.fitted) == (0.5, 0.25, 0.25, False)
