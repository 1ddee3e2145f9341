"""Feed status and the choice of what may be published."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.policy import linear_freshness
from tidemark.functions.timing import seconds_between

# fixed values: full-freshness age and fade per feed kind, age shown without data (seconds)
FADE = {"bars": (120.0, 3600.0, 60.0), "etf": (86400.0, 86400.0, 3600.0), "macro": (604800.0, 604800.0, 3600.0)}


def source_status(gated: DataFrame, updates: DataFrame, now: str = "now") -> DataFrame:
    """Status of each tracked feed at each evaluation time.

    gated: feeds(source_id, dataset_id, kind, series, now) after the rights gate; updates:
    (kind, series, now, last_update_at). Denied feeds are DISABLED or RIGHTS_BLOCKED. A feed
    without data reads as healthy. `mode` and `overall_quality` drop when any feed is denied.
    """
    d = gated.join(updates, ["kind", "series", now], "left")
    age = F.greatest(F.lit(0.0), seconds_between("last_update_at", now))
    factor, empty_age = F.lit(1.0), F.lit(3600.0)
    for kind, (full, fade, shown) in FADE.items():
        factor = F.when(F.col("kind") == kind, linear_freshness(age, full, fade)).otherwise(factor)
        empty_age = F.when(F.col("kind") == kind, F.lit(shown)).otherwise(empty_age)
    has = F.col("last_update_at").isNotNull()
    factor = F.when(has, factor).otherwise(F.lit(1.0))
    on = F.col("allowed")
    rows = d.select(
        now, "source_id", "dataset_id", "allowed",
        F.when(~on, F.when(F.col("reason_code").contains("DISABLED"), "DISABLED").otherwise("RIGHTS_BLOCKED"))
        .when(factor > 0.5, "HEALTHY").otherwise("DEGRADED").alias("state"),
        F.when(on, F.round(factor, 4)).otherwise(0.0).alias("freshness_factor"),
        F.when(on, F.round(F.when(has, age).otherwise(empty_age), 1)).otherwise(0.0).alias("age_seconds"),
        F.when(on, F.coalesce("last_update_at", F.col(now))).alias("last_update_at"),
        (~on).alias("is_hard_stop"))
    overall = rows.groupBy(now).agg(F.bool_and("allowed").alias("_all"))
    return (rows.join(overall, now)
            .withColumn("mode", F.when(F.col("_all"), "FULL").otherwise("TECH_MACRO"))
            .withColumn("overall_quality", F.when(F.col("_all"), 0.98).otherwise(0.75)).drop("_all", "allowed"))


def publication_choice(slots: DataFrame, snapshots: DataFrame, models: DataFrame, key: list[str]) -> DataFrame:
    """Status, reason and chosen model per slot.

    slots(key…, now); snapshots(key…, origin, cutoff_at, expires_at, rights_allowed) with origin
    1 = cache, 2 = store; models(key…, place, rights_allowed, compatible, calibrated, prediction)
    with place 1 = champion, 2 = fallback. The first valid snapshot and the first usable model
    win; both sides are reduced by one aggregate per key.
    """
    s = snapshots.join(slots, key)
    valid = (F.col("cutoff_at") <= F.col("now")) & (F.col("now") < F.col("expires_at"))
    snap = s.where(valid).groupBy(*key).agg(
        F.min_by("rights_allowed", "origin").alias("_rights"), F.min("origin").alias("origin"))
    usable = F.col("rights_allowed") & F.col("compatible") & F.col("calibrated") & F.col("prediction").isNotNull()
    pick = models.where(usable).groupBy(*key).agg(
        F.min("place").alias("place"), F.min_by("prediction", "place").alias("prediction"))
    d = slots.join(snap, key, "left").join(pick, key, "left")
    reason = (F.when(F.col("_rights").isNull(), "STALE_OR_MISSING_SNAPSHOT")
              .when(~F.col("_rights"), "RIGHTS_BLOCKED").when(F.col("place").isNull(), "NO_VALID_MODEL")
              .when(F.col("place") == 1, "OK").otherwise("APPROVED_ROLLBACK"))
    d = d.withColumn("reason", reason)
    current = F.col("reason").isin("OK", "APPROVED_ROLLBACK")
    return d.select(*key, F.when(current, "CURRENT").otherwise("UNAVAILABLE").alias("status"), "reason",
                    F.when(current, F.col("prediction")).alias("prediction"),
                    (F.col("reason") == "APPROVED_ROLLBACK").alias("rolled_back"))
