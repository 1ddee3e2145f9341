"""Signal ledger: current pointer, pages, round trips, outbox and inbox rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import STATUSES
from tidemark.functions.policy import projected_status

PAIR = ["market_id", "horizon"]


def current_signal(ledger: DataFrame) -> DataFrame:
    """Newest signal per (market, horizon) by (cutoff, sequence); a later issue wins equal keys.

    One map-side aggregate: a busy pair sends one row per task.
    """
    rest = [c for c in ledger.columns if c not in PAIR]
    return (ledger.groupBy(*PAIR)
            .agg(F.max_by(F.struct(*rest), F.struct("cutoff_at", "sequence", "issued_at")).alias("s"))
            .select(*PAIR, "s.*"))


def latest_with_tag(ledger: DataFrame, now: Column) -> DataFrame:
    """Current signals with projected status and the cache tag id-sequence-status."""
    d = current_signal(ledger).withColumn("projected_status", projected_status("status", "expires_at", now))
    return d.withColumn("tag", F.concat_ws("-", "signal_id", "sequence", "projected_status"))


def signal_page(ledger: DataFrame, market_id: str, horizon: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page by falling sequence. The page size is the feature; limit + offset rows per task."""
    return (ledger.where((F.col("market_id") == market_id) & (F.col("horizon") == horizon))
            .orderBy(F.col("sequence").desc()).offset(offset).limit(limit))


def signal_count(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))


def first_by_key(events: DataFrame, key: str = "dedupe_key", order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """First event of each key wins. An aggregate, so duplicates collapse before the shuffle."""
    rest = [c for c in events.columns if c != key]
    return (events.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("e"))
            .select(key, "e.*"))


def pending(outbox: DataFrame, limit: int = 50) -> DataFrame:
    """Oldest pending events, at most `limit`."""
    return outbox.where("status = 'PENDING'").orderBy("created_at", "id").limit(limit)


def unseen(events: DataFrame, inbox: DataFrame, consumer: str, event_id: str = "id") -> DataFrame:
    """Events the consumer has not processed."""
    seen = inbox.where(F.col("consumer_name") == consumer).select(F.col("event_id").alias(event_id))
    return events.join(seen, event_id, "left_anti")


def not_superseded(records: DataFrame) -> DataFrame:
    """Records no other record supersedes."""
    gone = records.where("supersedes_id IS NOT NULL").select(F.col("supersedes_id").alias("record_id"))
    return records.join(gone, "record_id", "left_anti")


def tenant_rows(df: DataFrame, tenant_id: int | str | None) -> DataFrame:
    """Rows of one tenant; without a tenant there are none."""
    if tenant_id is None:
        return df.where(F.lit(False))
    return df.where(F.col("tenant_id") == tenant_id)


def watchlist_view(watchlists: DataFrame, ledger: DataFrame, max_markets: int = 20) -> DataFrame:
    """Watchlist entries against the current signals, by name and list position."""
    items = (watchlists.where(F.size("markets") <= max_markets)
             .select("tenant_id", "id", "name", F.posexplode("markets").alias("position", "market_id")))
    now = current_signal(ledger).select(*PAIR, "signal_id", "label", "status")
    return items.join(now, "market_id", "left").orderBy("name", "id", "position", "horizon")


NESTED = ("struct<probabilities:struct<p_down:double,p_flat:double,p_up:double>,status:string,"
          "mode:string,label:string,reasons:array<struct<code:string,direction:string,weight:double>>>")


def to_document(nested: Column) -> Column:
    return F.to_json(nested)


def from_document(text: Column) -> Column:
    """Typed view of a stored document; an unknown status reads as UNAVAILABLE, an unknown label as NULL."""
    from tidemark.constants import LABELS, MODE_PILLARS
    d = F.from_json(text, NESTED)
    return F.struct(
        d["probabilities"].alias("probabilities"),
        F.when(d["status"].isin(*STATUSES), d["status"]).otherwise("UNAVAILABLE").alias("status"),
        F.when(d["mode"].isin(*MODE_PILLARS), d["mode"]).otherwise("RESEARCH").alias("mode"),
        F.when(d["label"].isin(*LABELS), d["label"]).alias("label"),
        d["reasons"].alias("reasons"))


def with_sequence(signals: DataFrame) -> DataFrame:
    """Sequence numbers per (market, horizon) by cutoff, without a window over a whole pair."""
    from tidemark.functions.timing import time_bucket
    from tidemark.operators.sequence import with_row_index
    return with_row_index(signals, PAIR, [F.col("cutoff_at")], time_bucket("cutoff_at", 86400), "sequence")


def change_feed(ledger: DataFrame) -> DataFrame:
    """Change feed: rows where the current signal of the pair becomes another one."""
    w = Window.partitionBy(*PAIR, "_day").orderBy("cutoff_at", "sequence", "issued_at")
    from tidemark.functions.timing import time_bucket
    from tidemark.operators.sequence import Carry, last_value, with_carry
    d = ledger.withColumn("_day", time_bucket("cutoff_at", 86400))
    order = F.struct("cutoff_at", "sequence", "issued_at")
    d = with_carry(d, PAIR, "_day", {"_before": Carry(F.max_by("signal_id", order), last_value)})
    return (d.withColumn("previous_id", F.coalesce(F.lag("signal_id").over(w), F.col("_before")))
            .where(F.col("previous_id").isNull() | (F.col("previous_id") != F.col("signal_id")))
            .drop("_day", "_before"))
