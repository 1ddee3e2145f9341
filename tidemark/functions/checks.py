"""Row checks: named violations, never exceptions, so bad rows can be counted or set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import LABELS, MARKET_ID_RE, MAX_EVENT_BYTES, NEWS_STATUSES, TITLE_LIMIT
from tidemark.functions.numeric import finite


def violations(rules: dict[str, Column]) -> Column:
    """Array of the names of broken rules; a rule that is NULL is not broken."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]),
                    lambda x: x.isNotNull())


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, quarantined rows with their violations)."""
    d = df.withColumn("violations", violations(rules))
    return d.where(F.size("violations") == 0).drop("violations"), d.where(F.size("violations") > 0)


def envelope_problems() -> dict[str, Column]:
    return {"seen_after_available": F.col("first_seen_at") > F.col("available_at"),
            "valid_interval": F.col("valid_from") > F.col("valid_to")}


def news_problems() -> dict[str, Column]:
    return {
        "clock": (F.col("source_observed_at") > F.col("first_seen_at"))
                 | (F.col("first_seen_at") > F.col("available_at")),
        "title_too_long": F.length("title") > TITLE_LIMIT,
        "negative_revision": F.col("revision") < 0,
        "asset": ~F.col("asset").isin("BTC", "ETH"),
        "empty_id": (F.coalesce(F.col("event_id"), F.lit("")) == "")
                    | (F.coalesce(F.col("publisher"), F.lit("")) == ""),
        "status": ~F.col("status").isin(*NEWS_STATUSES),
        "sentiment": ~finite(F.col("sentiment")) | ~F.col("sentiment").between(-1, 1),
        "relevance": ~finite(F.col("relevance")) | ~F.col("relevance").between(0, 1),
    }


def probability_problems() -> dict[str, Column]:
    ps = [F.col(c) for c in ("p_down", "p_flat", "p_up")]
    bad = [~finite(p) for p in ps]
    out = [~p.between(0, 1) for p in ps]
    return {"not_finite": bad[0] | bad[1] | bad[2], "out_of_range": out[0] | out[1] | out[2],
            "sum": F.abs(ps[0] + ps[1] + ps[2] - 1.0) > 1e-5}


def market_id_parts(c: Column | str) -> dict[str, Column]:
    m = F.col(c) if isinstance(c, str) else c
    ok = F.coalesce(m.rlike(MARKET_ID_RE), F.lit(False))
    return {"valid": ok, "venue": F.when(ok, F.split_part(m, F.lit(":"), F.lit(1))),
            "symbol": F.when(ok, F.split_part(m, F.lit(":"), F.lit(2)))}


def quote_problems(as_of: Column | None = None) -> dict[str, Column]:
    amounts = ["bid", "ask", "bid_size", "ask_size", "preceding_minute_notional"]
    bad = [~finite(F.col(c)) | (F.col(c) < 0) for c in amounts]
    any_bad = bad[0]
    for b in bad[1:]:
        any_bad = any_bad | b
    rules = {
        "amount": any_bad,
        "spread": ~((F.col("bid") > 0) & (F.col("bid") <= F.col("ask"))),
        "clock": F.col("observed_at") > F.col("available_at"),
        "asset": ~F.col("asset").isin("BTC", "ETH"),
        "book": F.coalesce(F.col("book_id"), F.lit("")) == "",
        "market_id": F.col("market_id").isNotNull() & ~F.col("market_id").rlike(MARKET_ID_RE),
    }
    if as_of is not None:
        rules["future_quote"] = (F.col("available_at") > as_of) | (F.col("observed_at") > as_of)
    return rules


def paper_signal_problems() -> dict[str, Column]:
    return {"asset": ~F.col("asset").isin("BTC", "ETH"),
            "label": F.col("label").isNotNull() & ~F.col("label").isin(*LABELS),
            "validity": F.col("expires_at") <= F.col("issued_at")}


def clock_problems(frozen_at: Column) -> dict[str, Column]:
    return {"entry_before_cutoff": F.col("entry_at") < F.col("cutoff_at"),
            "exit_not_after_entry": F.col("exit_at") <= F.col("entry_at"),
            "available_before_exit": F.col("available_at") < F.col("exit_at"),
            "immature": F.col("available_at") > frozen_at}


def event_too_large(payload: Column) -> Column:
    return F.octet_length(payload) > MAX_EVENT_BYTES


def leaks_at(available: str, cutoff: str) -> Column:
    """True where something is used before it was available; available = cutoff is fine."""
    return F.col(available) > F.col(cutoff)


def pit_leaks(df: DataFrame, available: str, cutoff: str) -> DataFrame:
    """Rows that leak; must be empty."""
    return df.where(leaks_at(available, cutoff))
