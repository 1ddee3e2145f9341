"""Policy, signal, ledger and alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.constants import OPERATIONS, PILLARS
from tidemark.functions import policy
from tidemark.functions.checks import leaks_at, probability_problems, violations
from tidemark.functions.timing import plus_seconds
from tidemark.operators import alerts, bars, costs, fusion, ledger, status
from tidemark.operators.etf import reconcile
from tidemark.operators.events import event_blackout as blackout
from tidemark.operators.indicators import MIN_BARS, indicators, number_bars
from tidemark.operators.reference import asof_etf, asof_macro
from tidemark.operators.rights import rights_gate as gate
from tidemark.plans import signals as S
from tidemark.plans.catalog_news import news_block
from tidemark.plans.registry import QUERIES, plain, query
from tidemark.plans.snapshot import dedupe_key, feature_snapshot, lacks_features, scalar_columns
from tidemark.plans.snapshot import snapshot_digest as digest
from tidemark.sources import testtables as tt

KEY = ["market_id", "horizon", "cutoff_at"]


def snapshot(spark, sf, width_s=60, technical=tuple(MIN_BARS)):
    return feature_snapshot(
        tt.decisions(spark, sf), bars.ohlcv(tt.trades(spark, sf), width_s), tt.macro_observations(spark, sf),
        reconcile(tt.etf_cells(spark, sf)), news_block(spark, sf), tt.rights_sources(spark),
        tt.rights_policies(spark), technical)


@query
def signals(spark, sf):
    """Flagship: minute bars, all indicators, four pillars as of each cutoff, fused and labelled."""
    snap = snapshot(spark, sf)
    events = blackout(tt.decisions(spark, sf), tt.macro_calendar(spark, sf))
    return plain(S.signals(snap, events, tt.bundles(spark)).drop("signal_id"))


@query
def feature_snapshot_query(spark, sf):
    s = snapshot(spark, sf)
    return plain(s.select(*KEY, "bars_in_lookback", *scalar_columns(s), *[f"{p}_active" for p in PILLARS], "mode",
                          (F.size("lineage") + F.coalesce("news_event_count", F.lit(0.0))).cast("bigint").alias("lineage_size")))


@query
def pillar_quality(spark, sf):
    s = snapshot(spark, sf)
    return plain(s.select(*KEY, *[f"{p}_{n}" for p in PILLARS for n in ("validity", "completeness", "freshness")]))


@query
def coverage_mode(spark, sf):
    s = snapshot(spark, sf)
    return plain(s.groupBy("horizon", *[f"{p}_active" for p in PILLARS],
                           F.coalesce("mode", F.lit("UNSUPPORTED")).alias("mode"),
                           F.coalesce(policy.mode_serves(F.lit("FULL"), F.col("mode")), F.lit(False)).alias("full_serves"))
                 .agg(F.count(F.lit(1)).alias("n")))


@query
def pit_leak_audit(spark, sf):
    """Rows of the snapshot that use an input from after their cutoff (must be none)."""
    s = snapshot(spark, sf)
    used = s.withColumn("used", F.greatest("newest_input_at", plus_seconds("bar_close_at", 2)))
    return plain(used.groupBy().agg(F.count(F.lit(1)).alias("n_rows"), F.max("used").alias("newest"),
                                    F.count_if(leaks_at("used", "cutoff_at")).alias("leaks")))


@query
def schema_compat(spark, sf):
    s = snapshot(spark, sf)
    need = F.array(*[F.lit(n) for n in ("tech_bb_pct_b", "macro_cpi_mom_pct", "etf_net_flow_usd", "news_sentiment")])
    return plain(s.select(*KEY, (~lacks_features(s, need)).alias("compatible")))


@query
def snapshot_digest(spark, sf):
    s = snapshot(spark, sf)
    return s.select(dedupe_key(digest(s)).alias("dedupe_key"))


@query
def rights_gate(spark, sf):
    names = ("binance", "coinbase", "bls", "farside", "gdelt", "reddit", "fed_board", "unknown")
    sets = ("spot_trades", "us_spot_etf_flows", "cpi")
    e = tt.read(spark, sf, "events").selectExpr(
        "event_id", f"{tt._pick('user_id', names)} AS source_id", f"{tt._pick('event_id div 8', sets)} AS dataset_id",
        f"{tt._pick('event_id', OPERATIONS)} AS operation", "CAST(ts AS TIMESTAMP) AS requested_at")
    return plain(gate(e, tt.rights_sources(spark), tt.rights_policies(spark))
                 .select("event_id", "allowed", "reason_code", "policy_id"))


@query
def event_blackout(spark, sf):
    d = tt.decisions(spark, sf)
    cal = tt.macro_calendar(spark, sf)
    # releases that were never seen stay open, so a second pass looks at the seen ones alone
    both = blackout(d, cal).select(*KEY, "in_blackout", "suppress_publication", "event_no", "event_type",
                                   F.lit("all").alias("calendar"))
    seen = blackout(d, cal.where("first_seen_at IS NOT NULL")).select(
        *KEY, "in_blackout", "suppress_publication", "event_no", "event_type", F.lit("seen").alias("calendar"))
    return plain(both.unionByName(seen).withColumn("event_no", F.coalesce("event_no", F.lit(-1))))


@query
def freshness_decay(spark, sf):
    """Age of the newest trade of each market at every hourly cutoff, under two hard stops."""
    b = number_bars(bars.ohlcv(tt.trades(spark, sf)))
    d = bars.asof_bar(tt.decisions(spark, sf), b, ["close_usd"])
    d = d.withColumn("f", policy.freshness("bar_close_at", "cutoff_at", 600.0)) \
         .withColumn("g", policy.freshness("bar_close_at", "cutoff_at", 60.0, 600.0, 1800.0))
    return plain(d.select(*KEY, *[F.col(f"{x}.{n}").alias(f"{n}_{x}") for x in "fg"
                                  for n in ("state", "factor", "hard_stop", "age_s", "overdue_s")],
                          policy.tape_stale("bar_close_at", "cutoff_at").alias("tape_stale")))


def minute_volatility(spark, sf):
    return indicators(bars.ohlcv(tt.trades(spark, sf)), ("tech_ewma_volatility",))


@query
def economic_hurdle(spark, sf):
    d = minute_volatility(spark, sf).withColumn(
        "horizon", F.explode(F.array(*[F.lit(h) for h in ("scalp_15m", "swing_24h", "position_30d")])))
    v = F.coalesce("tech_ewma_volatility", F.lit(-1.0))
    return plain(d.select("market_id", "bar_close_at", "horizon", policy.economic_hurdle(v).alias("theta"),
                          policy.economic_hurdle(v, interval_s=3600.0).alias("theta_hourly")))


def outcomes(spark, sf):
    b = minute_volatility(spark, sf)
    d = bars.asof_bar(tt.decisions(spark, sf), b, ["tech_ewma_volatility"])
    d = costs.outcome_prices(d.select(*KEY, "tech_ewma_volatility"), tt.trades(spark, sf))
    theta = policy.economic_hurdle(F.coalesce("tech_ewma_volatility", F.lit(0.0)))
    return d.withColumn("theta", theta).withColumn(
        "outcome", policy.outcome_class(F.col("entry_price"), F.col("exit_price"), F.col("theta")))


@query
def outcome_labels(spark, sf):
    return plain(outcomes(spark, sf).select(*KEY, "theta", "outcome"))


def wide_predictions(spark, sf):
    p = tt.pillar_predictions(spark, sf)
    return p.groupBy("row_id").agg(*[
        F.max(F.when(F.col("pillar") == x, F.col(c))).alias(f"{x}_{n}")
        for x in PILLARS for c, n in (("quality", "q"), ("p_down", "d"), ("p_flat", "f"), ("p_up", "u"))]
    ).withColumn("horizon", F.expr(tt.horizon_of("row_id")))


@query
def system_quality(spark, sf):
    d = wide_predictions(spark, sf)
    return plain(d.select("row_id", policy.system_quality({p: F.col(f"{p}_q") for p in PILLARS}).alias("q")))


@query
def mask_quality(spark, sf):
    d = wide_predictions(spark, sf)
    q = {p: F.col(f"{p}_q") for p in PILLARS}
    return plain(d.select("row_id", policy.mask_quality(q, {p: q[p] > 0.5 for p in PILLARS}).alias("q")))


@query
def probability_checks(spark, sf):
    d = tt.pillar_predictions(spark, sf)
    i = F.col("row_id")
    d = (d.withColumn("p_up", F.when(i % 9 == 0, F.col("p_up") + 1e-4).when(i % 10 == 0, F.col("p_up") + 5e-6)
                      .when(i % 11 == 0, F.col("p_up") + 1).otherwise(F.col("p_up")))
         .withColumn("p_down", F.when(i % 13 == 0, F.lit(float("nan"))).when(i % 17 == 0, -F.col("p_down"))
                     .otherwise(F.col("p_down"))))
    return plain(d.select("row_id", "pillar", F.array_join(violations(probability_problems()), ",").alias("violations")))


@query
def label_ladder(spark, sf):
    d = wide_predictions(spark, sf)
    i = F.col("row_id")
    raw = [F.pow(F.col(f"technical_{k}"), F.lit(8)) for k in "dfu"]
    total = raw[0] + raw[1] + raw[2]
    p = [x / total for x in raw]
    mode = F.when(i % 9 == 0, "CORE_NO_ETF").when(i % 9 == 1, "TECH_MACRO").when(i % 9 == 2, "RESEARCH") \
        .when(i % 9 == 3, F.lit(None)).otherwise("FULL")
    parts = [tuple(F.col(f"{x}_{k}") for k in "dfu") for x in PILLARS]
    q = 0.70 + (i % 31) / F.lit(100.0)
    lad = policy.label_ladder(p[0], p[1], p[2], q, mode, F.when(i % 6 != 0, 0.55 + (i % 10) / F.lit(100.0)),
                              i % 7 == 0, i % 11 != 0, i % 13 == 0,
                              policy.agreeing_pillars(parts, "UP"), policy.agreeing_pillars(parts, "DOWN"))
    return plain(d.withColumn("l", lad).select("row_id", "l.*"))


def fusion_input(spark, sf):
    """Predictions with horizon and mode by row; some macro predictions are missing."""
    d = tt.pillar_predictions(spark, sf)
    gone = (F.col("row_id") % 17 == 0) & (F.col("pillar") == "macro")
    return (d.withColumn("horizon", F.expr(tt.horizon_of("row_id")))
            .withColumn("mode", F.expr(tt._pick("row_id div 3", ("FULL", "CORE_NO_ETF", "TECH_MACRO"))))
            .select("row_id", "pillar", "horizon", "mode", "quality",
                    *[F.when(~gone, F.col(c)).alias(c) for c in ("p_down", "p_flat", "p_up")]))


def fused(spark, sf):
    w = fusion.baseline_weights(spark).withColumnRenamed("baseline", "weight")
    d = fusion_input(spark, sf)
    return d, w, fusion.fuse(d, w, ["row_id"], 1.7)


@query
def fusion_probs(spark, sf):
    return plain(fused(spark, sf)[2].select("row_id", "degraded", *[f"fused_{c}" for c in fusion.CLASSES]))


@query
def fusion_weights(spark, sf):
    """Weights learned from the mean pillar quality, admitted against the baseline bands."""
    d = fusion_input(spark, sf)
    base = fusion.baseline_weights(spark)
    learned = (d.groupBy("horizon", "mode", "pillar").agg(F.avg("quality").alias("m"))
               .join(base, ["horizon", "mode", "pillar"])
               .select("horizon", "mode", "pillar", (F.col("baseline") * (0.62 + F.col("m"))).alias("learned")))
    return plain(fusion.admit_weights(base, learned))


@query
def logodds_attribution(spark, sf):
    d, w, f = fused(spark, sf)
    a = fusion.attribution(d, f, w, ["row_id"], 1.7)
    return plain(a.select("row_id", "pillar", "selected", "opposite", "op_weight", "raw_diff", "contribution",
                          (F.col("residual") <= 1e-6).alias("reproduced")))


@query
def explanation_factors(spark, sf):
    d, w, f = fused(spark, sf)
    a = fusion.attribution(d, f, w, ["row_id"], 1.7)
    four = fusion.top_factors(a, ["row_id"]).withColumn("max_factors", F.lit(4))
    two = fusion.top_factors(a, ["row_id"], 2).withColumn("max_factors", F.lit(2))
    return plain(four.unionByName(two))


@query
def source_status(spark, sf):
    cut = tt.decisions(spark, sf).select(F.col("cutoff_at").alias("now")).distinct()
    feeds = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(
        ("source_id", "dataset_id", "operation", "kind", "series"), row)]) for row in (
        ("binance", "spot_trades", "COLLECT", "bars", "binance:BTCUSDT"),
        ("fed_board", "h15_yields", "COLLECT", "macro", "US_EFFR"),
        ("bls", "cpi", "COMPUTE_FEATURES", "macro", "US_CPI_HEADLINE_SA"),
        ("farside", "us_spot_etf_flows", "COMPUTE_FEATURES", "etf", "BTC"))])
    asked = cut.withColumn("_f", F.explode(feeds)).select("now", "_f.*")
    gated = gate(asked, tt.rights_sources(spark), tt.rights_policies(spark), at="now")
    at = cut.select(F.col("now").alias("cutoff_at"))
    m = asof_macro(at, tt.macro_observations(spark, sf))
    macro = [m.select(F.lit("macro").alias("kind"), F.lit(s).alias("series"), F.col("cutoff_at").alias("now"),
                      F.col(f"{a}.macro_available_at").alias("last_update_at"))
             for s, a in (("US_EFFR", "effr"), ("US_CPI_HEADLINE_SA", "cpi"))]
    e = asof_etf(at.withColumn("asset", F.lit("BTC")), reconcile(tt.etf_cells(spark, sf)))
    etf = e.select(F.lit("etf").alias("kind"), F.lit("BTC").alias("series"), F.col("cutoff_at").alias("now"),
                   F.col("etf.etf_available_at").alias("last_update_at"))
    b = number_bars(bars.ohlcv(tt.trades(spark, sf)).where("market_id = 'binance:BTCUSDT'"))
    bar = bars.asof_bar(at.withColumn("market_id", F.lit("binance:BTCUSDT")), b, [])
    bar = bar.select(F.lit("bars").alias("kind"), F.col("market_id").alias("series"), F.col("cutoff_at").alias("now"),
                     plus_seconds("bar_close_at", 2).alias("last_update_at"))
    updates = macro[0].unionByName(macro[1]).unionByName(etf).unionByName(bar)
    return plain(status.source_status(gated, updates))


@query
def publication_choice(spark, sf):
    L = tt.signal_ledger(spark, sf)
    n = F.col("sequence")
    slots = L.select("signal_id", plus_seconds("cutoff_at", (n % 7) * 300).alias("now"))
    cache = L.where(n % 5 != 0).select("signal_id", F.lit(1).alias("origin"), "cutoff_at", "expires_at",
                                       (n % 19 != 0).alias("rights_allowed"))
    store = L.select("signal_id", F.lit(2).alias("origin"), "cutoff_at", plus_seconds("cutoff_at", 1200).alias("expires_at"),
                     F.lit(True).alias("rights_allowed"))
    champion = L.select("signal_id", F.lit(1).alias("place"), (n % 3 != 0).alias("rights_allowed"),
                        F.lit(True).alias("compatible"), (n % 4 != 0).alias("calibrated"),
                        F.when(n % 6 != 5, F.concat(F.lit("c"), n)).alias("prediction"))
    fallback = L.where(n % 2 == 0).select("signal_id", F.lit(2).alias("place"), F.lit(True).alias("rights_allowed"),
                                          (n % 8 != 0).alias("compatible"), F.lit(True).alias("calibrated"),
                                          F.concat(F.lit("f"), n).alias("prediction"))
    return plain(status.publication_choice(slots, cache.unionByName(store), champion.unionByName(fallback), ["signal_id"]))


@query
def active_bundle(spark, sf):
    d = tt.decisions(spark, sf).select("horizon", "cutoff_at").distinct()
    return plain(S.bundle_at(d, tt.bundles(spark), live_only=True).select("horizon", "cutoff_at", "model_bundle", "bundle_mode"))


# ---- ledger -------------------------------------------------------------------------------
@query
def current_signal(spark, sf):
    return plain(ledger.current_signal(tt.signal_ledger(spark, sf)))


@query
def latest_signal(spark, sf):
    now = F.lit("2024-01-30 23:02:00").cast("timestamp")
    return plain(ledger.latest_with_tag(tt.signal_ledger(spark, sf), now).select(
        "market_id", "horizon", "signal_id", "status", "projected_status", "tag"))


@query
def signal_count(spark, sf):
    return plain(ledger.signal_count(tt.signal_ledger(spark, sf)))


@query
def signal_page(spark, sf):
    return plain(ledger.signal_page(tt.signal_ledger(spark, sf), "coinbase:BTC-USD", "swing_24h", 50, 100))


@query
def change_feed(spark, sf):
    return plain(ledger.change_feed(tt.signal_ledger(spark, sf)).select(
        "market_id", "horizon", "signal_id", F.coalesce("previous_id", F.lit("")).alias("previous_id")))


@query
def signal_sequence(spark, sf):
    d = tt.decisions(spark, sf)
    return plain(ledger.with_sequence(d))


@query
def signal_roundtrip(spark, sf):
    L = tt.signal_ledger(spark, sf)
    n = F.col("sequence")
    c = F.coalesce("confidence", F.lit(0.4))
    doc = ledger.to_document(F.struct(
        F.struct(((1 - c) / 2).alias("p_down"), ((1 - c) / 2).alias("p_flat"), c.alias("p_up")).alias("probabilities"),
        F.when(n % 11 == 0, "BROKEN").otherwise(F.col("status")).alias("status"),
        F.when(n % 13 == 0, "MYSTERY").otherwise("FULL").alias("mode"),
        F.when(n % 7 == 0, "Unknown").otherwise(F.col("label")).alias("label"),
        F.array(F.struct(F.concat(F.lit("CODE_"), n % 5).alias("code"), F.lit("UP").alias("direction"),
                         (n % 100 / F.lit(8.0)).alias("weight"))).alias("reasons")))
    d = L.select("signal_id", doc.alias("document")).withColumn("d", ledger.from_document(F.col("document")))
    return plain(d.select("signal_id", "d.status", "d.mode", "d.label", "d.probabilities.p_up", "d.probabilities.p_down",
                          F.col("d.reasons")[0]["code"].alias("code"), F.col("d.reasons")[0]["weight"].alias("weight")))


@query
def outbox_pending(spark, sf):
    return plain(ledger.pending(tt.outbox(spark, sf), 50).select("id", "dedupe_key", "created_at"))


@query
def outbox_dedup(spark, sf):
    return plain(ledger.first_by_key(tt.outbox(spark, sf)).select("dedupe_key", "id", "event_type", "created_at", "status"))


@query
def inbox_anti(spark, sf):
    return plain(ledger.unseen(tt.outbox(spark, sf), tt.inbox(spark, sf), "alerts").select("id", "dedupe_key"))


@query
def watchlist_view(spark, sf):
    return plain(ledger.watchlist_view(tt.watchlists(spark, sf), tt.signal_ledger(spark, sf)))


@query
def tenant_filter(spark, sf):
    w = tt.watchlists(spark, sf)
    one = ledger.tenant_rows(w, 3).withColumn("asked_by", F.lit("3"))
    none = ledger.tenant_rows(w, None).withColumn("asked_by", F.lit("unset"))
    return plain(one.unionByName(none).select("asked_by", "tenant_id", "id", "name"))


@query
def alert_dispatch(spark, sf):
    return plain(alerts.dispatch(tt.signal_ledger(spark, sf), tt.subscriptions(spark, sf)))


@query
def alert_candidates(spark, sf):
    """Triggering (subscription, signal) pairs before cooldown and quota."""
    c = alerts.candidates(tt.signal_ledger(spark, sf), tt.subscriptions(spark, sf))
    return plain(c.select("subscription_id", "signal_id", "label", "confidence", "reason"))


QUERIES["feature_snapshot"] = QUERIES.pop("feature_snapshot_query")
