"""Log-opinion pooling of pillar probabilities and its exact attribution.

Long form in: one row per (decision, pillar). One grouped aggregate per decision; weights are a
constant table keyed by horizon and mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.constants import FACTOR_CODES, MODE_PILLARS, PILLARS, PRIORS
from tidemark.functions.numeric import clamp01, floored_ln, largest_class, softmax
from tidemark.functions.timing import col

CLASSES = ("down", "flat", "up")


def baseline_weights(spark: SparkSession) -> DataFrame:
    """Priors restricted to the pillars of each mode and normalised (horizon, mode, pillar)."""
    rows = []
    for horizon, priors in PRIORS.items():
        for mode, pillars in MODE_PILLARS.items():
            total = sum(priors[p] for p in pillars)
            rows += [(horizon, mode, p, priors[p] / total) for p in pillars]
    return spark.createDataFrame(rows, "horizon string, mode string, pillar string, baseline double")


def admit_weights(baseline: DataFrame, learned: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Learned weights inside [0.5·b, 1.5·b], renormalised per (horizon, mode).

    A missing pillar takes its baseline. `in_bounds` is false for the whole set when any weight
    leaves its band; such a set must not be used.
    """
    key = ["horizon", "mode"]
    d = (baseline.join(learned, [*key, "pillar"], "left")
         .withColumn("weight", F.coalesce("learned", "baseline"))
         .withColumn("_ok", F.col("weight").between(F.col("baseline") * 0.5 - tolerance,
                                                    F.col("baseline") * 1.5 + tolerance)))
    w = Window.partitionBy(*key)
    return d.select(*key, "pillar", "baseline",
                    (F.col("weight") / F.sum("weight").over(w)).alias("weight"),
                    F.min("_ok").over(w).alias("in_bounds"))


def fuse(predictions: DataFrame, weights: DataFrame, key: list[str],
         temperature: Column | float = 1.0, intercepts: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Fused probabilities per decision from predictions(key…, pillar, p_down, p_flat, p_up, quality).

    `weights` holds (horizon, mode, pillar, weight); predictions must carry horizon and mode.
    A weight row without a prediction still counts in the normaliser with its quality; when its
    operational weight is above 1e-9 the decision is degraded. So is a weight sum of at most 1e-9.
    """
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    d = (predictions.join(weights, ["horizon", "mode", "pillar"])
         .withColumn("_raw", F.col("weight") * clamp01(F.coalesce("quality", F.lit(0.0))))
         .withColumn("_have", F.col("p_down").isNotNull()))
    agg = d.groupBy(*key).agg(
        F.sum("_raw").alias("_total"),
        F.max(F.when(~F.col("_have"), F.col("_raw")).otherwise(0.0)).alias("_lost"),
        *[F.sum(F.when(F.col("_have") & (F.col("_raw") > 0), F.col("_raw") * floored_ln(F.col(f"p_{c}")))
                .otherwise(0.0)).alias(f"_z_{c}") for c in CLASSES])
    total = F.col("_total")
    degraded = (total <= 1e-9) | (F.col("_lost") / total > 1e-9)
    z = [F.lit(a) + F.col(f"_z_{c}") / total for a, c in zip(intercepts, CLASSES)]
    probs = softmax([zi / t for zi in z])
    return agg.select(*key, degraded.alias("degraded"), F.when(total > 1e-9, total).alias("weight_total"),
                      *[F.when(~degraded, p).alias(f"fused_{c}") for p, c in zip(probs, CLASSES)])


def selected_and_opposite(down: Column, flat: Column, up: Column) -> tuple[Column, Column]:
    """Chosen class and the class it is explained against (UP wins a tie of the sides)."""
    sel = largest_class(down, flat, up)
    opp = (F.when(sel == "UP", "DOWN").when(sel == "DOWN", "UP")
           .otherwise(F.when(up >= down, "UP").otherwise("DOWN")))
    return sel, opp


def by_class(which: Column, down: Column, flat: Column, up: Column) -> Column:
    return F.when(which == "DOWN", down).when(which == "FLAT", flat).otherwise(up)


def attribution(predictions: DataFrame, fused: DataFrame, weights: DataFrame, key: list[str],
                temperature: float = 1.0,
                intercepts: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Per pillar contribution to the log odds of the selected against the opposite class.

    `residual` is the distance between the sum of contributions and the reported log odds.
    """
    sel, opp = selected_and_opposite(*[col(f"fused_{c}") for c in CLASSES])
    f = (fused.where("NOT degraded").withColumn("selected", sel).withColumn("opposite", opp)
         .withColumn("_reported", floored_ln(by_class(F.col("selected"), *[F.col(f"fused_{c}") for c in CLASSES]))
                     - floored_ln(by_class(F.col("opposite"), *[F.col(f"fused_{c}") for c in CLASSES])))
         .withColumn("_icpt", by_class(F.col("selected"), *[F.lit(a) for a in intercepts])
                     - by_class(F.col("opposite"), *[F.lit(a) for a in intercepts])))
    ps = [F.col(f"p_{c}") for c in CLASSES]
    d = (predictions.where("p_down IS NOT NULL").join(weights, ["horizon", "mode", "pillar"])
         .join(f, key)
         .withColumn("op_weight", F.col("weight") * clamp01(F.coalesce("quality", F.lit(0.0)))
                     / F.col("weight_total"))
         .withColumn("raw_diff", floored_ln(by_class(F.col("selected"), *ps))
                     - floored_ln(by_class(F.col("opposite"), *ps)))
         .withColumn("contribution_pre", F.col("op_weight") * F.col("raw_diff"))
         .withColumn("contribution", F.col("contribution_pre") / temperature))
    w = Window.partitionBy(*key)
    return d.withColumn("residual", F.abs(F.col("_icpt") + F.sum("contribution_pre").over(w)
                                          - F.col("_reported") * temperature)).select(
        *key, "pillar", "selected", "opposite", "op_weight", "raw_diff", "contribution_pre",
        "contribution", "residual")


def factor_code(pillar: Column, direction: Column) -> Column:
    out = None
    for (p, d), code in FACTOR_CODES.items():
        cond = (pillar == p) & (direction == d)
        out = F.when(cond, code) if out is None else out.when(cond, code)
    return out.otherwise(F.concat_ws("_", F.upper(pillar), direction))


def top_factors(contributions: DataFrame, key: list[str], limit: int = 4) -> DataFrame:
    """The strongest contributions per decision with reason codes.

    When none of them opposes but an opposing one exists, it takes the last place. A decision has
    at most as many rows as there are pillars.
    """
    w = Window.partitionBy(*key).orderBy(F.abs("contribution").desc(), "pillar")
    against = F.col("contribution") < 0
    d = (contributions.withColumn("_rank", F.row_number().over(w))
         .withColumn("_first_against", F.min(F.when(against, F.col("_rank"))).over(Window.partitionBy(*key))))
    shift = F.coalesce(F.col("_first_against") > limit, F.lit(False))
    keep = F.when(shift, (F.col("_rank") < limit) | (F.col("_rank") == F.col("_first_against"))) \
            .otherwise(F.col("_rank") <= limit)
    direction = F.when(against, F.col("opposite")).otherwise(F.col("selected"))
    return (d.where(keep)
            .withColumn("position", F.least(F.col("_rank"), F.lit(limit)).cast("bigint"))
            .withColumn("direction", direction)
            .withColumn("code", factor_code(F.col("pillar"), F.col("direction")))
            .select(*key, "position", "pillar", "direction", "code", "contribution"))


def wide_fusion(probs: dict[str, tuple[Column, Column, Column]], quality: dict[str, Column],
                weights: dict[str, Column], temperature: float = 1.0) -> dict[str, Column]:
    """The same pool for one row that holds all pillars: no shuffle. Weight 0 leaves a pillar out."""
    raw = {p: weights[p] * clamp01(F.coalesce(quality[p], F.lit(0.0))) for p in PILLARS}
    total = sum(list(raw.values())[1:], raw[PILLARS[0]])
    lost = F.greatest(*[F.when(probs[p][0].isNull(), raw[p]).otherwise(0.0) for p in PILLARS])
    degraded = (total <= 1e-9) | (lost / total > 1e-9)
    z = []
    for k in range(3):
        terms = [F.when(probs[p][k].isNotNull() & (raw[p] > 0), raw[p] * floored_ln(probs[p][k])).otherwise(0.0)
                 for p in PILLARS]
        z.append(sum(terms[1:], terms[0]) / total / temperature)
    d, f, u = softmax(z)
    return {"degraded": degraded, "p_down": d, "p_flat": f, "p_up": u}
