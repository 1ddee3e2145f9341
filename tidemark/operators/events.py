"""Blackout windows around official releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timing import plus_seconds, time_bucket
from tidemark.operators.asof import asof

DAY = 86400


def event_blackout(decisions: DataFrame, calendar: DataFrame, feed_is_healthy: bool = True) -> DataFrame:
    """Add in_blackout, suppress_publication, event_no, event_type to each decision.

    A window runs from five minutes before the schedule to ten minutes after the release was
    seen, both ends inclusive. It stays open while the release is unseen or the feed unhealthy.
    Of several windows the event of lowest order counts. Decisions are not shuffled by time:
    distinct cutoffs are evaluated and joined back.
    """
    cal = calendar.withColumn("_from", plus_seconds("scheduled_at", -300))
    closed = F.col("first_seen_at").isNotNull() & F.lit(feed_is_healthy)
    cutoffs = decisions.select("cutoff_at").distinct()

    bounded = (cal.where(closed)
               .withColumn("_to", plus_seconds(F.greatest("scheduled_at", "first_seen_at"), 600))
               .withColumn("_day", F.explode(F.sequence(time_bucket("_from", DAY), time_bucket("_to", DAY)))))
    hits = (cutoffs.withColumn("_day", time_bucket("cutoff_at", DAY))
            .join(bounded, "_day")
            .where(F.col("cutoff_at").between(F.col("_from"), F.col("_to")))
            .groupBy("cutoff_at")
            .agg(F.min_by(F.struct("event_no", "event_type"), "event_no").alias("_bounded")))

    # open windows never end: the running lowest order is a step function of time. The release
    # calendar has a few dozen rows a year; its year number keeps the window partitioned.
    open_ = cal.where(~closed).select("_from", F.struct("event_no", "event_type").alias("_e"))
    year = open_.withColumn("_y", F.year("_from"))
    per_year = year.groupBy("_y").agg(F.min("_e").alias("_m"))
    carry = per_year.select("_y", F.min("_m").over(
        Window.partitionBy(F.lit(0)).orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)).alias("_c"))
    steps = (year.join(carry, "_y", "left")
             .withColumn("_low", F.least(F.col("_c"), F.min("_e").over(
                 Window.partitionBy("_y").orderBy("_from")
                 .rowsBetween(Window.unboundedPreceding, 0))))
             .select("_from", F.col("_low").alias("_open")))
    at = asof(cutoffs, steps, [], "cutoff_at", "_from", ["_open"]).join(hits, "cutoff_at", "left")
    at = at.select("cutoff_at", F.least("_open", "_bounded").alias("_hit"))
    inside = F.col("_hit").isNotNull()
    return (decisions.join(at, "cutoff_at", "left")
            .select(*decisions.columns, inside.alias("in_blackout"),
                    (inside & (F.col("horizon") == "scalp_15m")).alias("suppress_publication"),
                    F.col("_hit.event_no").alias("event_no"), F.col("_hit.event_type").alias("event_type")))
