"""As-of look-ups of slow tables (macro, fund flows, news polls) at distinct cutoffs.

These values depend on the cutoff (and the asset), not on the market, so they are computed once
per distinct cutoff and joined back to the decisions by equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import asof

MACRO_INPUTS = {"US_CPI_HEADLINE_SA": "cpi", "US_EFFR": "effr"}


def asof_macro(cutoffs: DataFrame, observations: DataFrame,
               series: dict[str, str] = MACRO_INPUTS) -> DataFrame:
    """Newest observation per series at each cutoff, one struct column per series.

    Newest is the highest (available_at, revision_seq, reference_period, record_id); rows that
    share an availability are reduced before the join.
    """
    rank = F.struct("revision_seq", "reference_period", "record_id")
    fields = ["record_id", "value", "mom_pct", "yoy_pct", "reference_period", "revision_seq"]
    best = (observations.where(F.col("series_id").isin(*series))
            .groupBy("series_id", F.col("available_at").alias("macro_available_at"))
            .agg(F.max_by(F.struct(*fields), rank).alias("r"))
            .select("series_id", "macro_available_at",
                    F.struct("macro_available_at", "r.*").alias("macro")))
    wanted = cutoffs.withColumn("series_id", F.explode(F.array(*[F.lit(s) for s in series])))
    found = asof(wanted, best, ["series_id"], "cutoff_at", "macro_available_at", ["macro"])
    return found.groupBy("cutoff_at").agg(*[
        F.first(F.when(F.col("series_id") == s, F.col("macro")), ignorenulls=True).alias(a)
        for s, a in series.items()])


def asof_etf(cutoffs: DataFrame, flows: DataFrame) -> DataFrame:
    """Newest flow per (asset, cutoff): highest (available_at, revision, session, record)."""
    rank = F.struct("revision_seq", "session_date", "record_id")
    fields = ["record_id", "session_date", "flow_usd", "coverage_ratio", "status"]
    best = (flows.groupBy(F.col("asset_id").alias("asset"), F.col("available_at").alias("etf_available_at"))
            .agg(F.max_by(F.struct(*fields), rank).alias("r"))
            .select("asset", "etf_available_at", F.struct("etf_available_at", "r.*").alias("etf")))
    return asof(cutoffs, best, ["asset"], "cutoff_at", "etf_available_at", ["etf"])


def asof_poll(cutoffs: DataFrame, polls: DataFrame) -> DataFrame:
    """Newest poll per (asset, cutoff)."""
    p = polls.select("asset", "checked_at", F.struct("checked_at", "coverage_capped", "model_version")
                     .alias("poll"))
    return asof(cutoffs, p, ["asset"], "cutoff_at", "checked_at", ["poll"])
