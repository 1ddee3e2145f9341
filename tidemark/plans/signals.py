"""Decision slots to signals: experts, fusion, ladder and hurdle over the snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import MODE_PILLARS, PILLARS, PRIORS, by_horizon
from tidemark.functions.numeric import softmax
from tidemark.functions.policy import agreeing_pillars, economic_hurdle, label_ladder, system_quality
from tidemark.functions.timing import plus_seconds
from tidemark.operators.fusion import wide_fusion
from tidemark.plans.snapshot import pillar_scores

# A frozen linear expert per pillar: class logits = intercept + Σ coefficient · feature.
# Class order is down, flat, up; a missing feature counts zero.
LINEAR_EXPERTS = {
    "technical": dict(intercept=(0.9, 0.0, -0.9), coef={"tech_bb_pct_b": (-1.8, 0.0, 1.8)}),
    "macro": dict(intercept=(0.0, 0.2, 0.0), coef={"macro_cpi_mom_pct": (0.01, 0.0, -0.01)}),
    "etf": dict(intercept=(0.0, 0.0, 0.4), coef={"etf_net_flow_usd": (-2e-10, 0.0, 2e-10),
                                                 "etf_coverage_ratio": (0.0, 0.1, 0.0)}),
    "news": dict(intercept=(0.0, 0.1, 0.0), coef={"news_sentiment": (-4.0, 0.0, 4.0),
                                                  "news_rumor_share": (0.0, 0.5, 0.0)}),
}


def linear_expert(pillar: str, experts: dict = LINEAR_EXPERTS) -> tuple[Column, Column, Column]:
    """p_down, p_flat, p_up of a multinomial logistic expert as column expressions."""
    spec = experts[pillar]
    z = []
    for k in range(3):
        out = F.lit(float(spec["intercept"][k]))
        for name, coef in spec["coef"].items():
            out = out + F.lit(float(coef[k])) * F.coalesce(F.col(name), F.lit(0.0))
        z.append(out)
    return tuple(softmax(z))


def mode_weight(pillar: str, horizon: str = "horizon", mode: str = "bundle_mode") -> Column:
    """Baseline weight of a pillar for (horizon, mode); 0 when the mode leaves it out."""
    out = F.lit(0.0)
    for m, pillars in MODE_PILLARS.items():
        if pillar not in pillars:
            continue
        for h, priors in PRIORS.items():
            total = sum(priors[p] for p in pillars)
            out = F.when((F.col(horizon) == h) & (F.col(mode) == m), F.lit(priors[pillar] / total)).otherwise(out)
    return out


def bundle_at(decisions: DataFrame, bundles: DataFrame, at: str = "cutoff_at",
              live_only: bool = False) -> DataFrame:
    """Newest generation created by the cutoff, per horizon, expired or not (or live ones only).

    The register is configuration (a few rows per horizon): it joins as one array per horizon,
    so decisions are not shuffled for it.
    """
    fields = ["generation", "bundle_id", "mode", "created_at", "expires_at", "reliability_lower", "is_calibrated"]
    per = bundles.groupBy("horizon").agg(F.collect_list(F.struct(*fields)).alias("_bundles"))
    d = decisions.join(per, "horizon", "left")
    newest = F.array_max(F.filter("_bundles", lambda b: (b["created_at"] <= F.col(at)) & (
        F.lit(not live_only) | (F.col(at) < b["expires_at"]))))
    d = d.withColumn("_b", newest)
    return d.select(*decisions.columns, *[F.col(f"_b.{f}").alias(n) for f, n in (
        ("bundle_id", "model_bundle"), ("mode", "bundle_mode"), ("expires_at", "bundle_expires_at"),
        ("reliability_lower", "reliability_lower"), ("is_calibrated", "is_calibrated"))])


def signals(snapshot: DataFrame, blackout: DataFrame, bundles: DataFrame) -> DataFrame:
    """The signal row of every decision. A map over the snapshot apart from the joins by key.

    `blackout` adds in_blackout and suppress_publication per decision.
    """
    d = bundle_at(snapshot, bundles)
    scores = pillar_scores()
    d = d.select("*", system_quality(scores).alias("_q"),
                 *[s.alias(f"_s_{p}") for p, s in scores.items()],
                 *[F.struct(*[c.alias(k) for c, k in zip(linear_expert(p), ("d", "f", "u"))]).alias(f"_p_{p}")
                   for p in PILLARS],
                 *[mode_weight(p).alias(f"_w_{p}") for p in PILLARS])
    key = ["market_id", "horizon", "cutoff_at"]
    d = d.join(blackout.select(*key, "in_blackout", "suppress_publication"), key, "left")
    probs = {p: tuple(F.col(f"_p_{p}.{k}") for k in ("d", "f", "u")) for p in PILLARS}
    pool = wide_fusion(probs, {p: F.col(f"_s_{p}") for p in PILLARS}, {p: F.col(f"_w_{p}") for p in PILLARS})
    d = d.select("*", *[v.alias(f"_f_{k}") for k, v in pool.items()])
    used = [probs[p] for p in PILLARS]
    ladder = label_ladder(
        F.col("_f_p_down"), F.col("_f_p_flat"), F.col("_f_p_up"), F.col("_q"), F.col("mode"),
        F.col("reliability_lower"), F.coalesce("in_blackout", F.lit(False)),
        F.coalesce("is_calibrated", F.lit(False)), F.coalesce("suppress_publication", F.lit(False)),
        agreeing_pillars(used, "UP"), agreeing_pillars(used, "DOWN"))
    d = d.withColumn("_l", ladder)
    none = F.lit(None).cast("string")

    def outcome(reason, quality):
        return F.struct(F.lit("UNAVAILABLE").alias("status"), none.alias("label"),
                        F.lit(None).cast("double").alias("confidence"), none.alias("confidence_event"),
                        F.lit(reason).alias("reason"), quality.alias("data_quality"), F.lit(False).alias("scored"))

    expired = F.col("bundle_expires_at").isNull() | (F.col("cutoff_at") >= F.col("bundle_expires_at"))
    other_mode = ~F.coalesce(F.col("bundle_mode") == F.col("mode"), F.lit(False))
    zero = F.lit(0.0)
    result = (F.when(expired, outcome("MODEL_APPROVAL_EXPIRED", zero))
              .when(other_mode, outcome("UNSUPPORTED_SOURCE_MASK", zero))
              .when(F.col("_f_degraded"), outcome("UNSUPPORTED_SOURCE_MASK", F.col("_q")))
              .otherwise(F.struct("_l.status", "_l.label", "_l.confidence", "_l.confidence_event", "_l.reason",
                                  F.col("_q").alias("data_quality"), F.lit(True).alias("scored"))))
    d = d.withColumn("_r", result)
    scored = F.col("_r.scored")
    hurdle = economic_hurdle(F.coalesce("tech_ewma_volatility", F.lit(0.0)))
    return d.select(
        *key, F.sha2(F.concat_ws("|", "market_id", "horizon", F.unix_micros("cutoff_at")), 256).alias("signal_id"),
        F.col("_r.status").alias("status"), "mode", F.col("_r.label").alias("label"),
        F.col("_r.confidence").alias("confidence"), F.col("_r.confidence_event").alias("confidence_event"),
        F.col("_r.reason").alias("reason"), F.col("_r.data_quality").alias("data_quality"),
        *[F.when(scored, F.col(f"_f_p_{k}")).alias(f"p_{k}") for k in ("down", "flat", "up")],
        F.when(scored, hurdle).otherwise(0.0).alias("outcome_hurdle"), "model_bundle",
        F.col("cutoff_at").alias("issued_at"),
        plus_seconds("cutoff_at", by_horizon("ttl_s")).alias("expires_at"))
