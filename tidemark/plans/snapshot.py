"""Four-pillar feature snapshot for all markets, horizons and cutoffs in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import MAX_SCALARS, PILLARS, by_horizon
from tidemark.functions.policy import coverage_mode, freshness, tape_stale
from tidemark.functions.timing import stamp
from tidemark.operators.bars import asof_bar
from tidemark.operators.indicators import MIN_BARS, indicators
from tidemark.operators.news import NEWS_SCALARS
from tidemark.operators.reference import asof_etf, asof_macro
from tidemark.operators.rights import rights_gate
from tidemark.session import cut_lineage

FEEDS = {"macro": ("bls", "cpi"), "etf": ("farside", "us_spot_etf_flows"), "news": ("gdelt", "article_metadata")}


def feed_rights(cutoffs: DataFrame, sources: DataFrame, policies: DataFrame) -> DataFrame:
    """macro_allowed, etf_allowed and news_allowed per cutoff for feature computation."""
    asks = F.array(*[F.struct(F.lit(p).alias("feed"), F.lit(s).alias("source_id"), F.lit(d).alias("dataset_id"))
                     for p, (s, d) in FEEDS.items()])
    req = (cutoffs.withColumn("_a", F.explode(asks)).select("cutoff_at", "_a.*")
           .withColumn("operation", F.lit("COMPUTE_FEATURES")))
    got = rights_gate(req, sources, policies, at="cutoff_at")
    return got.groupBy("cutoff_at").agg(*[
        F.bool_or((F.col("feed") == p) & F.col("allowed")).alias(f"{p}_allowed") for p in FEEDS])


def feature_snapshot(decisions: DataFrame, bars: DataFrame, macro: DataFrame, flows: DataFrame,
                     news: DataFrame, sources: DataFrame, policies: DataFrame,
                     technical: tuple[str, ...] = tuple(MIN_BARS), earlier: DataFrame | None = None) -> DataFrame:
    """One wide row per (market, horizon, cutoff): scalars, active pillars, qualities, mode.

    `bars` may hold the indicators already; then `earlier` lists the bars before them (operators.bars.asof_bar).

    Only the bar look-up depends on the market. Macro values and rights are found per distinct
    cutoff, flows and news per (asset, horizon, cutoff), and join back by equality. `news` is the
    news feature block.
    """
    d = decisions.withColumn("asset", F.when(F.col("market_id").contains("BTC"), "BTC").otherwise("ETH"))
    # the look-up reads the indicators several times, so they are written once
    series = bars if set(technical) <= set(bars.columns) else cut_lineage(indicators(bars, technical))
    d = asof_bar(d, series, list(technical), earlier)
    cutoffs = decisions.select("cutoff_at").distinct()
    assets = cutoffs.withColumn("asset", F.explode(F.array(F.lit("BTC"), F.lit("ETH"))))
    per_cutoff = asof_macro(cutoffs, macro).join(feed_rights(cutoffs, sources, policies), "cutoff_at", "left")
    d = (d.join(per_cutoff, "cutoff_at", "left")
         .join(asof_etf(assets, flows), ["asset", "cutoff_at"], "left")
         .join(news, ["asset", "horizon", "cutoff_at"], "left"))

    may_macro, may_etf, may_news = (F.coalesce(F.col(f"{p}_allowed"), F.lit(False)) for p in FEEDS)
    cpi, effr, etf = F.when(may_macro, F.col("cpi")), F.when(may_macro, F.col("effr")), F.when(may_etf, F.col("etf"))
    tech_on = F.col("bars_in_lookback") >= 1
    two = F.col("bars_in_lookback") >= 2
    active = {"technical": tech_on, "macro": cpi.isNotNull() | effr.isNotNull(), "etf": etf.isNotNull(),
              "news": may_news & F.coalesce("news_active", F.lit(False))}
    fresh = freshness("bar_close_at", "cutoff_at", 60.0, hard_stop_s=by_horizon("tape_stop_s"))
    zero, one = F.lit(0.0), F.lit(1.0)
    on = lambda p, v: F.when(active[p], v).otherwise(zero)
    quality = {
        "technical": (F.when(tech_on & tape_stale("bar_close_at", "cutoff_at"), zero).otherwise(one),
                      on("technical", F.least(one, F.col("bars_in_lookback") / 60.0)),
                      on("technical", fresh["factor"])),
        "macro": (F.when(may_macro, one).otherwise(zero), on("macro", one), on("macro", one)),
        "etf": (F.when(may_etf, one).otherwise(zero),
                on("etf", F.greatest(zero, F.least(one, etf["coverage_ratio"]))), on("etf", one)),
        "news": (F.when(may_news, one).otherwise(zero), on("news", one), on("news", one)),
    }
    # at most three records; the news records are rows of their own (operators.news.news_lineage)
    lineage = F.filter(F.array(F.concat(F.lit("macro:"), cpi["record_id"].cast("string")),
                               F.concat(F.lit("macro:"), effr["record_id"].cast("string")),
                               etf["record_id"].cast("string")), lambda x: x.isNotNull())
    return d.select(
        *decisions.columns, "asset", "bars_in_lookback", "bar_close_at",
        *[F.when(two, F.col(t)).alias(t) for t in technical],
        cpi["value"].alias("macro_cpi_level"), cpi["mom_pct"].alias("macro_cpi_mom_pct"),
        effr["value"].alias("macro_effr_rate"),
        etf["flow_usd"].alias("etf_net_flow_usd"), etf["coverage_ratio"].alias("etf_coverage_ratio"),
        *[F.when(active["news"], F.col(n)).alias(n) for n in NEWS_SCALARS],
        *[active[p].alias(f"{p}_active") for p in PILLARS],
        *[q.alias(f"{p}_{n}") for p in PILLARS for n, q in zip(("validity", "completeness", "freshness"), quality[p])],
        coverage_mode(active).alias("mode"), lineage.alias("lineage"),
        F.greatest(cpi["macro_available_at"], effr["macro_available_at"], etf["etf_available_at"],
                   F.when(active["news"], F.col("news_newest_at"))).alias("newest_input_at"))


SCALAR_PREFIXES = ("tech_", "macro_", "etf_", "news_")
NOT_SCALAR = ("_active", "_validity", "_completeness", "_freshness")


def scalar_columns(snapshot: DataFrame) -> list[str]:
    names = sorted(n for n, t in snapshot.dtypes if t == "double" and n.startswith(SCALAR_PREFIXES)
                   and not n.endswith(NOT_SCALAR))
    if len(names) > MAX_SCALARS:
        raise ValueError(f"{len(names)} scalars exceed the limit of {MAX_SCALARS}")
    return names


def scalar_map(snapshot: DataFrame) -> Column:
    """The scalars that are present, as a map (the form stored at the table edge)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).alias("v")) for n in scalar_columns(snapshot)])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def pillar_scores() -> dict[str, Column]:
    return {p: F.col(f"{p}_validity") * F.col(f"{p}_completeness") * F.col(f"{p}_freshness") for p in PILLARS}


def snapshot_digest(snapshot: DataFrame, version: str = "features_1.0.0") -> Column:
    """SHA-256 prefix of the canonical content (sorted names, six decimals)."""
    parts = [F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}="), F.format_string("%.6f", F.col(n))))
             for n in scalar_columns(snapshot)]
    text = F.concat_ws("|", "market_id", "horizon", stamp("cutoff_at"), F.lit(version), *parts)
    return F.substring(F.sha2(text, 256), 1, 32)


def dedupe_key(digest: Column) -> Column:
    return F.concat_ws(":", "market_id", "horizon", stamp("cutoff_at"), digest)


def lacks_features(snapshot: DataFrame, required: Column) -> Column:
    """True where a required feature name is absent from the snapshot."""
    return F.size(F.array_except(required, F.map_keys(scalar_map(snapshot)))) > 0
