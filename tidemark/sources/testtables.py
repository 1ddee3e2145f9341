"""Engine tables derived from the given parquet tables (projections and aggregates only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.constants import HORIZONS
from tidemark.functions.text import clean_title
from tidemark.operators.macro import with_changes

MARKETS = ("binance:BTCUSDT", "binance:ETHUSDT", "coinbase:BTC-USD", "coinbase:ETH-USD")
T0 = "TIMESTAMP '2024-01-01 00:00:00'"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: str, values) -> str:
    n = len(values)
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE ({index}) % {n} {arms} END"


def market_of(x: str) -> str:
    return _pick(x, MARKETS)


def horizon_of(x: str) -> str:
    return _pick(x, tuple(HORIZONS))


def _events(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(
        "CAST(event_id AS STRING) AS trade_id",
        f"{market_of('user_id')} AS market_id",
        "100 + value AS price_usd",
        "CAST(1 + event_id % 7 AS DOUBLE) AS size",
        "CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side",
        "ts AS event_time",
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly cutoffs for every market and horizon."""
    hours = (_events(spark, sf_dir)
             .select((F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 HOUR 2 SECONDS"))
                     .alias("cutoff_at"))
             .distinct())
    return (hours
            .withColumn("market_id", F.explode(F.array(*[F.lit(m) for m in MARKETS])))
            .withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in HORIZONS])))
            .select("market_id", "horizon", "cutoff_at"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (_events(spark, sf_dir).where("event_type IN ('view', 'click')").selectExpr(
        "CASE WHEN user_id % 2 = 0 THEN 'BTC' ELSE 'ETH' END AS asset",
        f"{market_of('user_id')} AS market_id",
        "100 + value AS bid",
        "(100 + value) * (1 + 0.0005D * (1 + event_id % 5)) AS ask",
        "CAST(1 + event_id % 11 AS DOUBLE) AS bid_size",
        "CAST(1 + event_id % 11 AS DOUBLE) AS ask_size",
        "CAST(10000 + 1000 * (event_id % 100) AS DOUBLE) AS preceding_minute_notional",
        "CAST(event_id AS STRING) AS book_id",
        "ts AS observed_at",
        "ts + make_dt_interval(0, 0, 0, event_id % 3) AS available_at",
        "event_id",
    ))


def paper_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ("Strong Buy", "Buy", "Neutral", "Sell", "Strong Sell")
    return _events(spark, sf_dir).where("event_type = 'signup'").selectExpr(
        "event_id AS signal_id",
        "CASE WHEN user_id % 2 = 0 THEN 'BTC' ELSE 'ETH' END AS asset",
        f"{market_of('user_id')} AS market_id",
        f"{horizon_of('event_id')} AS horizon",
        f"{_pick('event_id', labels)} AS label",
        "ts AS issued_at",
        "ts + INTERVAL 20 MINUTES AS expires_at",
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("event_type = 'purchase'").selectExpr(
        "event_id AS fill_id",
        "CASE WHEN user_id % 2 = 0 THEN 'BTC' ELSE 'ETH' END AS asset",
        "CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side",
        "CAST(user_id AS STRING) AS book_id",
        "ts AS at",
        "CAST(1 + event_id % 4 AS DOUBLE) AS quantity",
        "100 + value AS price",
        "CAST(10000 + 1000 * (event_id % 100) AS DOUBLE) AS preceding_minute_notional",
        "CAST(1 + event_id % 11 AS DOUBLE) AS depth",
    )


SERIES_OF_PRIORITY = """CASE SUBSTR(o_orderpriority, 1, 1) WHEN '1' THEN 'US_CPI_HEADLINE_SA'
    WHEN '2' THEN 'US_CPI_CORE_SA' WHEN '3' THEN 'US_EFFR' WHEN '4' THEN 'US_UST_2Y'
    ELSE 'US_UST_10Y' END"""


def macro_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions of five series; the lowest order key wins per (series, period, revision)."""
    o = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS record_id",
        f"{SERIES_OF_PRIORITY} AS series_id",
        "date_format(o_orderdate, 'yyyy-MM') AS reference_period",
        "CAST(o_orderkey % 3 AS INT) AS revision_seq",
        "o_totalprice AS value",
        f"{T0} + make_dt_interval(0, CAST((o_orderkey * 7919) % 720 AS INT), 0, 0) AS available_at",
    )
    key = ["series_id", "reference_period", "revision_seq"]
    first = (o.groupBy(*key)
             .agg(F.min_by(F.struct("record_id", "value", "available_at"), "record_id").alias("r"))
             .select(*key, "r.*"))
    return with_changes(first, by=["series_id", "revision_seq"], order=["reference_period"])


def etf_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text cell per (asset, session, fund) plus the reported total of the session."""
    cents = "CAST(ROUND(l_extendedprice * 100) AS BIGINT)"
    cells = (read(spark, sf_dir, "lineitem")
             .selectExpr(
                 "CASE WHEN l_orderkey % 2 = 0 THEN 'BTC' ELSE 'ETH' END AS asset_id",
                 "l_suppkey % 10 AS fund_no", "l_orderkey % 60 AS session_no", f"{cents} AS cents")
             .groupBy("asset_id", "fund_no", "session_no").agg(F.sum("cents").alias("cents"))
             .selectExpr(
                 "asset_id", "fund_no", "session_no",
                 "ROUND(cents / 1e6D, 1) AS value_m",
                 "(fund_no + session_no) % 17 = 0 AS missing"))
    totals = (cells.groupBy("asset_id", "session_no")
              .agg(F.sum(F.when(~F.col("missing"), F.col("value_m"))).alias("present"))
              .selectExpr(
                  "asset_id", "session_no",
                  """CASE WHEN session_no % 13 = 0 THEN '-'
                     ELSE CAST(ROUND(COALESCE(present, 0D), 1)
                          + CASE WHEN session_no % 11 = 0 THEN 1.0D ELSE 0.0D END AS STRING)
                     END AS total_text"""))
    return (cells.join(totals, ["asset_id", "session_no"])
            .selectExpr(
                "asset_id", "CONCAT('F', fund_no) AS fund_id",
                "DATE_ADD(DATE '2023-12-01', CAST(session_no AS INT)) AS session_date",
                "CASE WHEN missing THEN '-' ELSE CAST(value_m AS STRING) END AS value_text",
                "total_text"))


def news_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    statuses = "CASE n_chars % 6 WHEN 0 THEN 'RUMOR' WHEN 1 THEN 'ANNOUNCED' WHEN 2 THEN 'EFFECTIVE'" \
               " WHEN 3 THEN 'DENIED' WHEN 4 THEN 'CORRECTED' END"
    observed = f"{T0} + make_dt_interval(0, 0, CAST((doc_id * 37) % 2880 AS INT), 0)"
    title = clean_title("text")
    return (read(spark, sf_dir, "documents")
            .withColumn("title", title["title"])
            .withColumn("title_truncated", title["truncated"])
            .withColumn("body", title["full"])
            .selectExpr(
                "CAST(doc_id AS STRING) AS record_id",
                "CASE WHEN doc_id % 5 = 0 THEN CONCAT('K', doc_id div 10)"
                " ELSE CONCAT('D', doc_id) END AS source_key",
                "doc_id % 10 AS revision",
                "CASE WHEN (doc_id div 10) % 2 = 0 THEN 'BTC' ELSE 'ETH' END AS asset",
                "source AS publisher", "title", "title_truncated", "body",
                "CASE WHEN lang = 'en' THEN 'English' ELSE lang END AS language",
                f"{statuses} AS status",
                "(n_chars % 201 - 100) / 100.0D AS sentiment",
                "CASE WHEN lang = 'en' THEN (doc_id % 101) / 100.0D ELSE 0.0D END AS relevance",
                "CONCAT('E', doc_id % 900) AS event_id",
                "CAST(NULL AS TIMESTAMP) AS published_at",
                f"{observed} AS source_observed_at",
                f"{observed} + INTERVAL 1 MINUTE AS first_seen_at",
                f"{observed} + INTERVAL 2 MINUTES AS available_at",
            ))


def news_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One poll per asset and quarter hour in which any event happened."""
    slot = _events(spark, sf_dir).selectExpr("unix_micros(ts) div 900000000 AS q").distinct()
    return (slot.withColumn("asset", F.explode(F.array(F.lit("BTC"), F.lit("ETH"))))
            .selectExpr(
                "asset", "timestamp_micros(q * 900000000) AS checked_at",
                f"(q - unix_micros({T0}) div 900000000) % 29 = 0 AS coverage_capped",
                f"CASE WHEN (q - unix_micros({T0}) div 900000000) % 53 = 0 THEN 'm0' ELSE 'm1' END"
                " AS model_version"))


def pillar_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: one row per (row_id, pillar) with class probabilities and quality."""
    pillars = ("technical", "macro", "etf", "news")
    e = read(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS row_id", "label % 3 AS y",
        f"{T0} + make_dt_interval(0, CAST(vec_id AS INT), 0, 0) AS cutoff_at",
        "embedding",
    )
    one = [f"""named_struct('pillar', '{p}',
               'z_down', CAST(embedding[{3 * i}] AS DOUBLE) * 5,
               'z_flat', CAST(embedding[{3 * i + 1}] AS DOUBLE) * 5,
               'z_up', CAST(embedding[{3 * i + 2}] AS DOUBLE) * 5,
               'quality', LEAST(1.0D, ABS(CAST(embedding[{12 + i}] AS DOUBLE)) * 5))"""
           for i, p in enumerate(pillars)]
    from tidemark.functions.numeric import softmax
    long = e.selectExpr("row_id", "y", "cutoff_at", f"inline(array({', '.join(one)}))")
    d, f, u = softmax([F.col("z_down"), F.col("z_flat"), F.col("z_up")])
    return long.select(
        "row_id", "pillar", "y", "cutoff_at", "quality",
        d.alias("p_down"), f.alias("p_flat"), u.alias("p_up"))


def target_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS row_id", "CAST(label % 3 AS INT) AS y",
        f"{T0} + make_dt_interval(0, CAST(vec_id AS INT), 0, 0) AS cutoff_at",
        f"{T0} + make_dt_interval(0, CAST(vec_id AS INT), 0, 10) AS entry_at",
        f"{T0} + make_dt_interval(1, CAST(vec_id AS INT), 0, 10) AS exit_at",
        f"{T0} + make_dt_interval(1, CAST(vec_id AS INT), 0, 12) AS available_at",
    )


def macro_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = ("FOMC_DECISION", "FOMC_MINUTES", "CPI_RELEASE")
    sched = f"{T0} + make_dt_interval(0, n_nationkey * 29, 0, 0)"
    return read(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS event_no",
        f"{_pick('n_nationkey', types)} AS event_type",
        f"{sched} AS scheduled_at",
        f"CASE WHEN n_nationkey % 5 <> 0 THEN {sched} + make_dt_interval(0, 0, n_nationkey % 4, 0)"
        " END AS first_seen_at",
    )


LEDGER_TTL = "CASE o_orderkey % 3 WHEN 0 THEN 90 WHEN 1 THEN 1200 ELSE 21600 END"


def signal_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    cutoff = f"{T0} + make_dt_interval(0, CAST(o_orderkey % 720 AS INT), 0, 0)"
    return read(spark, sf_dir, "orders").selectExpr(
        "CONCAT('S', o_orderkey) AS signal_id",
        f"{market_of('o_custkey')} AS market_id",
        f"{horizon_of('o_orderkey')} AS horizon",
        "o_orderkey AS sequence",
        f"{cutoff} AS cutoff_at",
        f"{cutoff} + INTERVAL 5 SECONDS AS issued_at",
        f"{cutoff} + make_dt_interval(0, 0, 0, {LEDGER_TTL}) AS expires_at",
        "CASE o_orderstatus WHEN 'F' THEN 'READY' WHEN 'O' THEN 'ABSTAIN' ELSE 'UNAVAILABLE' END"
        " AS status",
        "CASE WHEN o_orderstatus = 'F' THEN CASE SUBSTR(o_orderpriority, 1, 1)"
        " WHEN '1' THEN 'Strong Buy' WHEN '2' THEN 'Buy' WHEN '3' THEN 'Neutral'"
        " WHEN '4' THEN 'Sell' ELSE 'Strong Sell' END END AS label",
        "CASE WHEN o_orderstatus = 'F' THEN 0.5D + (o_orderkey % 50) / 100.0D END AS confidence",
        "o_orderkey % 41 = 0 AS is_replay",
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS subscription_id",
        f"{market_of('c_nationkey')} AS market_id",
        f"{horizon_of('c_custkey')} AS horizon",
        "0.6D + (c_custkey % 4) / 20.0D AS min_confidence",
        "CASE WHEN c_custkey % 2 = 0 THEN array('Strong Buy', 'Buy', 'Sell', 'Strong Sell')"
        " ELSE array('Strong Buy', 'Strong Sell') END AS allowed_labels",
    )


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(
        "event_id AS id", "event_type",
        "CONCAT(event_type, ':', user_id, ':', date_format(ts, 'yyyy-MM-dd')) AS dedupe_key",
        "ts AS created_at",
        "CASE WHEN event_id % 3 <> 0 THEN 'PENDING' ELSE 'DISPATCHED' END AS status",
        "props AS payload",
    )


def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("event_id % 4 = 0").selectExpr(
        "'alerts' AS consumer_name", "event_id")


def watchlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    arr = ", ".join(f"'{m}'" for m in MARKETS)
    return read(spark, sf_dir, "supplier").selectExpr(
        "s_nationkey AS tenant_id", "s_suppkey AS id", "s_name AS name",
        f"slice(array({arr}), 1, CAST(1 + s_suppkey % 4 AS INT)) AS markets",
    )


def bundles(spark: SparkSession) -> DataFrame:
    """Small model-bundle register (configuration)."""
    rows = [
        ("b_scalp_1", "scalp_15m", "FULL", 1, "2023-12-01", "2024-01-10", 0.58, True),
        ("b_scalp_2", "scalp_15m", "FULL", 2, "2024-01-01", "2024-02-10", 0.62, True),
        ("b_swing_1", "swing_24h", "FULL", 1, "2023-12-01", "2024-01-20", 0.61, True),
        ("b_position_1", "position_30d", "FULL", 1, "2023-12-01", "2024-01-25", 0.66, True),
        ("b_position_2", "position_30d", "FULL", 2, "2024-01-06", "2024-03-01", 0.66, False),
    ]
    return (spark.createDataFrame(
        rows, "bundle_id string, horizon string, mode string, generation int, created string,"
              " expires string, reliability_lower double, is_calibrated boolean")
        .select("bundle_id", "horizon", "mode", "generation",
                F.to_timestamp("created").alias("created_at"),
                F.to_timestamp("expires").alias("expires_at"),
                "reliability_lower", "is_calibrated"))


def asset_of(market: Column | str = "market_id") -> Column:
    m = F.col(market) if isinstance(market, str) else market
    return F.when(m.contains("BTC"), F.lit("BTC")).otherwise(F.lit("ETH"))


def rights_sources(spark: SparkSession) -> DataFrame:
    """Source switches (configuration)."""
    return spark.createDataFrame([
        ("bls", True, None), ("fed_board", True, None), ("gdelt", True, None), ("farside", True, None),
        ("binance", True, None), ("coinbase", False, "CONSENT_REQUIRED"), ("reddit", False, None),
    ], "source_id string, enabled boolean, disabled_reason string")


def rights_policies(spark: SparkSession) -> DataFrame:
    """Registered policies (configuration)."""
    every = {o: "PERMITTED" for o in ("COLLECT", "RETAIN_RAW", "COMPUTE_FEATURES", "TRAIN_ML", "INFER_ML",
                                      "DISTRIBUTE_SIGNAL")}
    rows = [
        ("bls", "*", "p_bls", "2023-01-01 00:00:00", None, every, "", 1),
        ("fed_board", "default", "p_fed", "2023-01-01 00:00:00", None, every, "", 1),
        ("farside", "us_spot_etf_flows", "p_far", "2023-12-15 00:00:00", "2024-01-28 12:00:00",
         {"COMPUTE_FEATURES": "PERMITTED", "SERVE_DISPLAY": "DENIED"}, "vendor terms", 1),
        ("binance", "spot_trades", "p_bin_old", "2023-01-01 00:00:00", None, {}, "", 1),
        ("binance", "spot_trades", "p_bin", "2024-01-05 00:00:00", None,
         {"COLLECT": "PERMITTED", "EXPORT_RAW": "DENIED", "TRAIN_ML": "UNKNOWN"}, "venue terms", 2),
        ("binance", "*", "p_bin_any", "2023-01-01 00:00:00", "2024-01-20 00:00:00", {"COLLECT": "PERMITTED"}, "", 1),
        ("gdelt", "article_metadata", "p_gdelt", "2024-01-01 04:00:00", "2024-01-25 00:00:00", {"COMPUTE_FEATURES": "PERMITTED"}, "", 1),
    ]
    return (spark.createDataFrame(
        rows, "source_id string, dataset_id string, policy_id string, f string, t string,"
              " entitlements map<string,string>, rationale string, registered int")
        .select("source_id", "dataset_id", "policy_id", F.to_timestamp("f").alias("effective_from"),
                F.to_timestamp("t").alias("effective_to"), "entitlements", "rationale", "registered"))
