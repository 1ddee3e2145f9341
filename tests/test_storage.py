"""Sinks, pruned scans, and properties of the point-in-time plan."""

import contextlib
import io

from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.operators import bars, news
from tidemark.operators.indicators import number_bars
from tidemark.operators.reference import asof_macro
from tidemark.operators.sequence import with_row_index
from tidemark.functions.timing import time_bucket
from tidemark.sources import payloads, tables
from tidemark.sources import testtables as tt


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_append_and_pruned_scan(spark, folder):
    t = tt.trades(spark, SF)
    tables.append(t, "trades", f"{folder}/trades", ["market_id", "event_time"])
    d = tables.scan(spark, "trades", f"{folder}/trades", "2024-01-05 00:00:00", "2024-01-06 12:00:00").select("trade_id")
    want = t.where(F.col("event_time").between("2024-01-05 00:00:00", "2024-01-06 12:00:00"))
    assert d.count() == want.count() > 0
    text = plan(d)
    assert "PartitionFilters: [isnotnull(part" in text and "GreaterThanOrEqual(event_time" in text
    assert "ReadSchema: struct<trade_id:string,event_time:timestamp>" in text


def test_row_index_without_keys(spark):
    d = spark.range(1000).selectExpr("id", "timestamp_seconds(id * 977) AS t")
    got = with_row_index(d, [], [F.col("t")], time_bucket("t", 3600))
    assert got.where("idx <> id + 1").count() == 0


def test_later_rows_never_change_a_decision(spark):
    """Adding observations available after a cutoff leaves its result alone."""
    cut = tt.decisions(spark, SF).select("cutoff_at").distinct().where("cutoff_at < '2024-01-10'")
    m = tt.macro_observations(spark, SF)
    now = asof_macro(cut, m.where("available_at < '2024-01-10'"))
    later = asof_macro(cut, m)
    assert now.exceptAll(later).count() == 0 and later.exceptAll(now).count() == 0
    b = bars.ohlcv(tt.trades(spark, SF))
    d = tt.decisions(spark, SF).where("cutoff_at < '2024-01-10'")
    short = bars.asof_bar(d, number_bars(b.where("bar_close_at < '2024-01-10'")), ["close_usd"])
    full = bars.asof_bar(d, number_bars(b), ["close_usd"])
    assert short.exceptAll(full).count() == 0


def test_lookback_excludes_old_bars(spark):
    b = spark.sql("""SELECT 'm:X' market_id, timestamp'2020-01-01' bar_close_at, 1D close_usd, 1L idx UNION ALL
        SELECT 'm:X', timestamp'2022-01-01', 2D, 2L""")
    d = spark.sql("SELECT 'm:X' market_id, 'swing_24h' horizon, t cutoff_at FROM VALUES (timestamp'2021-06-01'), (timestamp'2022-06-01') AS v(t)")
    got = {r.cutoff_at.year: (r.bars_in_lookback, r.close_usd) for r in bars.asof_bar(d, b, ["close_usd"]).collect()}
    assert got == {2021: (0, None), 2022: (1, 2.0)}


def test_versions_skip_late_lower_revisions(spark):
    d = spark.sql("""SELECT * FROM VALUES ('r1', 'k', 5L, 10), ('r2', 'k', 3L, 20), ('r3', 'k', 6L, 999999999), ('r0', 'k', 1L, 5) AS t(record_id, source_key, revision, s)""") \
        .withColumn("asset", F.lit("BTC")).withColumn("available_at", F.timestamp_seconds("s"))
    got = {r.record_id: (r.valid_from.timestamp(), r.valid_to and r.valid_to.timestamp()) for r in news.news_versions(d).collect()}
    assert set(got) == {"r0", "r1", "r3"} and got["r1"][1] == got["r3"][0] and got["r3"][1] is None


def test_split_poll_is_capped_when_a_half_is(spark):
    l = spark.sql("SELECT 'BTC' asset, 'a' record_id, true coverage_capped")
    r = spark.sql("SELECT 'BTC' asset, 'b' record_id, false coverage_capped")
    assert {x.coverage_capped for x in payloads.merge_windows(l, r).collect()} == {True}
