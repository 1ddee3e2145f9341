"""Data-rights gate: enabled source, effective policy, entitlement. Unknown always denies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss'+00:00'"


def rights_gate(requests: DataFrame, sources: DataFrame, policies: DataFrame,
                at: str = "requested_at") -> DataFrame:
    """Add allowed, reason_code, policy_id to requests(source_id, dataset_id, operation, at).

    sources(source_id, enabled, disabled_reason); policies(source_id, dataset_id, policy_id,
    effective_from, effective_to, entitlements map, rationale, registered). The policy of the
    dataset wins over '*', which wins over 'default'; the latest registration counts. Both
    tables are configuration; their size decides at run time whether they are broadcast.
    """
    newest = (policies.groupBy("source_id", "dataset_id")
              .agg(F.max_by(F.struct("policy_id", "effective_from", "effective_to",
                                     "entitlements", "rationale"), "registered").alias("p")))
    star = newest.where("dataset_id = '*'").select("source_id", F.col("p").alias("p_star"))
    fallback = newest.where("dataset_id = 'default'").select("source_id", F.col("p").alias("p_default"))
    exact = newest.select("source_id", "dataset_id", F.col("p").alias("p_exact"))
    d = (requests.join(sources, "source_id", "left")
         .join(exact, ["source_id", "dataset_id"], "left")
         .join(star, "source_id", "left").join(fallback, "source_id", "left")
         .withColumn("_p", F.coalesce("p_exact", "p_star", "p_default")))
    now = F.col(at)
    granted = F.coalesce(F.try_element_at("_p.entitlements", F.col("operation")), F.lit("UNKNOWN"))
    why = F.when(F.coalesce("_p.rationale", F.lit("")) != "",
                 F.concat(F.lit(": "), F.col("_p.rationale"))).otherwise("")
    off = ~F.coalesce("enabled", F.lit(False))
    early = now < F.col("_p.effective_from")
    late = F.coalesce(now >= F.col("_p.effective_to"), F.lit(False))
    reason = (
        F.when(off, F.concat(F.lit("SOURCE_DISABLED: "), F.coalesce(
            "disabled_reason",
            F.concat(F.lit("Source '"), F.col("source_id"), F.lit("' is switched off")))))
        .when(F.col("_p").isNull(), "UNAUTHORIZED_UNKNOWN_PERMISSION: none is registered")
        .when(early, F.concat(F.lit("POLICY_NOT_YET_EFFECTIVE: valid from "),
                              F.date_format("_p.effective_from", ISO)))
        .when(late, F.concat(F.lit("POLICY_EXPIRED: valid until "), F.date_format("_p.effective_to", ISO)))
        .when(granted == "PERMITTED", "AUTHORIZED")
        .when(granted == "UNKNOWN", F.concat(F.lit("UNAUTHORIZED_UNKNOWN_PERMISSION"), why))
        .otherwise(F.concat(F.lit("OPERATION_EXPLICITLY_DENIED"), why)))
    policy = (F.when(off, "config_defaults").when(F.col("_p").isNull(), "missing_policy")
              .otherwise(F.col("_p.policy_id")))
    return (d.withColumn("reason_code", reason)
            .withColumn("allowed", F.col("reason_code") == "AUTHORIZED")
            .withColumn("policy_id", policy)
            .select(*requests.columns, "allowed", "reason_code", "policy_id"))
