"""Row checks, source jobs and matrices from end to end."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.constants import FEATURE_PREFIX, PILLARS
from tidemark.functions.checks import paper_signal_problems, violations
from tidemark.functions.policy import class_index
from tidemark.functions.text import clean_title, compose_nfc
from tidemark.operators import bars as B
from tidemark.operators import training
from tidemark.operators.etf import flow_problems, reconcile
from tidemark.plans.catalog_policy import KEY, outcomes, snapshot
from tidemark.plans.registry import plain, query
from tidemark.plans.snapshot import scalar_columns
from tidemark.session import cut_lineage
from tidemark.sources import payloads
from tidemark.sources import testtables as tt

#: letters of the test texts and their decomposed forms
DECOMPOSED = {c: unicodedata.normalize("NFD", c) for c in "éüñçóê"}


def problems(rules) -> Column:
    return F.array_join(violations(rules), ",").alias("violations")


@query
def trade_checks(spark, sf):
    """Trades with some values spoilt by rule."""
    t, i = tt.trades(spark, sf), F.col("trade_id").cast("bigint")
    t = t.withColumn("price_usd", F.when(i % 7 == 0, -F.col("price_usd")).otherwise(F.col("price_usd"))).withColumn("size", F.when(i % 5 == 0, 0.0).otherwise(F.col("size")))
    return plain(t.select("trade_id", problems(B.trade_problems())))


@query
def paper_signal_checks(spark, sf):
    """Paper signals with some values spoilt by rule."""
    s, i = tt.paper_signals(spark, sf), F.col("signal_id")
    s = (s.withColumn("asset", F.when(i % 7 == 0, "SOL").otherwise(F.col("asset"))).withColumn("label", F.when(i % 5 == 0, "Hold").when(i % 3 == 0, F.lit(None)).otherwise(F.col("label")))
         .withColumn("expires_at", F.when(i % 11 == 0, F.col("issued_at")).otherwise(F.col("expires_at"))))
    return plain(s.select("signal_id", problems(paper_signal_problems())))


@query
def scan_bars_window(spark, sf):
    b = B.ohlcv(tt.trades(spark, sf))
    return plain(B.bars_window(b, "coinbase:ETH-USD", "2024-01-05 00:00:00", "2024-01-12 12:30:00").select("market_id", "bar_close_at", "open_usd", "close_usd", "volume", "trade_count"))


@query
def etf_table(spark, sf):
    """Flow tables from their cells: a header of funds and a total, a row per session with its date in one of two spellings, then reconciliation and checks."""
    cells = cut_lineage(tt.etf_cells(spark, sf))
    funds = cells.select("asset_id", "fund_id").distinct()
    head = funds.groupBy("asset_id").agg(F.array_sort(F.collect_list("fund_id")).alias("funds"))   # the columns of a table
    day = F.when(F.dayofmonth("session_date") % 2 == 0, F.date_format("session_date", "dd MMM yyyy")).otherwise(F.date_format("session_date", "yyyy-MM-dd"))
    values = cells.groupBy("asset_id", "session_date").agg(F.map_from_entries(F.collect_list(F.struct("fund_id", "value_text"))).alias("v"), F.max("total_text").alias("total"))
    body = values.join(head, "asset_id").select("asset_id", F.datediff("session_date", F.lit("2023-11-30").cast("date")).alias("row_no"), F.concat(
        F.array(day), F.transform("funds", lambda f: F.try_element_at("v", f)), F.array("total")).alias("cells"))
    rows = body.unionByName(head.select("asset_id", F.lit(0).alias("row_no"), F.concat(F.array(F.lit("Date")), F.col("funds"), F.array(F.lit("Total"))).alias("cells")))
    d = reconcile(payloads.etf_table_cells(rows.withColumn("table_id", F.lit("t"))))
    return plain(d.select("asset_id", "session_date", "status", "flow_usd", "covered_funds", "expected_funds", "coverage_ratio", problems(flow_problems())), 2)


@query
def flow_checks(spark, sf):
    """Flow rows with their fund counts spoilt by rule."""
    d, n = reconcile(tt.etf_cells(spark, sf)), F.dayofmonth("session_date")
    d = d.withColumn("covered_funds", F.when(n % 5 == 0, F.col("expected_funds") + 1).otherwise(F.col("covered_funds"))).withColumn(
        "expected_funds", F.when(n % 7 == 0, F.lit(0)).otherwise(F.col("expected_funds")))
    return plain(d.select("asset_id", "session_date", problems(flow_problems())))


@query
def poll_window_halves(spark, sf):
    """A poll window split in two: rows of both halves, capped where either half was."""
    e = tt.news_evidence(spark, sf).select("asset", "record_id", "source_observed_at", (F.col("record_id").cast("bigint") % 97 == 0).alias("coverage_capped"))
    late = F.hour("source_observed_at") >= 12
    first, second = e.where(~late & (F.col("asset") == "BTC")), e.where(late)
    capped = lambda half: half.drop("coverage_capped").join(half.groupBy("asset").agg(F.bool_or("coverage_capped").alias("coverage_capped")), "asset")
    return plain(payloads.merge_windows(capped(first), capped(second)).select("asset", "record_id", "coverage_capped"))


@query
def nfc_titles(spark, sf):
    """Titles that arrive decomposed, composed before they are cleaned."""
    raw = F.col("text")
    for letter, parts in DECOMPOSED.items():
        raw = F.replace(raw, F.lit(letter), F.lit(parts))
    d = tt.read(spark, sf, "documents").select("doc_id", compose_nfc(raw).alias("composed"), F.length(raw).alias("chars_before"))
    t = clean_title("composed")
    return plain(d.select("doc_id", "chars_before", F.length("composed").alias("chars_after"), F.md5(t["title"]).alias("title_md5")))


@query
def pillar_matrices(spark, sf):
    """Feature vectors of all four pillars for every decision with a known outcome: size, present values, their sum and the first three."""
    s = cut_lineage(snapshot(spark, sf))
    y = outcomes(spark, sf).where("outcome IS NOT NULL").select(*KEY, class_index(F.col("outcome")).alias("y"))
    d, out = cut_lineage(s.join(y, KEY)), None
    for p in PILLARS:
        x = training.pillar_matrix(d, p, [c for c in scalar_columns(s) if c.startswith(FEATURE_PREFIX[p])])
        known = F.filter("features", lambda v: ~F.isnan(v))
        first = [F.when(~F.isnan(F.get("features", F.lit(i))), F.get("features", F.lit(i))).alias(f"f{i}") for i in range(3)]
        part = x.select(*KEY, F.lit(p).alias("pillar"), "y", F.size("features").alias("size"), F.size(known).alias("present"),
                        F.aggregate(known, F.lit(0.0), lambda a, v: a + v).alias("total"), *first)
        out = part if out is None else out.unionByName(part)
    return plain(out, 4)
