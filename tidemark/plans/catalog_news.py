"""News, text and payload queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.checks import news_problems, violations
from tidemark.functions.text import canonical_url as canonical
from tidemark.functions.text import clean_title as clean
from tidemark.operators import neardup, news, textmodel
from tidemark.operators.slotspans import slot_grid, slot_totals
from tidemark.plans.registry import QUERIES, plain, query
from tidemark.plans.snapshot import feed_rights
from tidemark.session import cut_lineage
from tidemark.sources import payloads
from tidemark.sources import testtables as tt

AGES = ("scalp_15m", "swing_24h", "position_30d")


def slots(spark, sf):
    """Distinct (asset, horizon, cutoff) of the decisions."""
    return (tt.decisions(spark, sf).withColumn("asset", tt.asset_of())
            .select("asset", "horizon", "cutoff_at").distinct())


def text_tables(items):
    """Text classes and the similar pairs that may meet; both are read several times, so they are written once."""
    classes = cut_lineage(neardup.text_classes(items, "body"))
    return classes, cut_lineage(neardup.similar_pairs(classes, places=neardup.places_of(items, classes)))


def news_rights(spark, sf):
    """news_allowed per distinct cutoff; a feed without a policy is denied."""
    cutoffs = tt.decisions(spark, sf).select("cutoff_at").distinct()
    return feed_rights(cutoffs, tt.rights_sources(spark), tt.rights_policies(spark))


def news_block(spark, sf):
    return news.news_features(slots(spark, sf), tt.news_evidence(spark, sf), tt.news_polls(spark, sf), text_tables, news_rights(spark, sf))


@query
def news_checks(spark, sf):
    """Evidence with some fields spoilt by rule."""
    i = F.col("record_id").cast("bigint")
    d = tt.news_evidence(spark, sf)
    d = (d.withColumn("sentiment", F.when(i % 7 == 0, F.col("sentiment") * 3).otherwise(F.col("sentiment")))
         .withColumn("relevance", F.when(i % 11 == 0, F.col("relevance") - 0.5).otherwise(F.col("relevance")))
         .withColumn("status", F.when(i % 13 == 0, "HEARSAY").otherwise(F.col("status")))
         .withColumn("asset", F.when(i % 17 == 0, "SOL").otherwise(F.col("asset")))
         .withColumn("publisher", F.when(i % 19 == 0, "").otherwise(F.col("publisher")))
         .withColumn("revision", F.when(i % 23 == 0, -1).otherwise(F.col("revision")))
         .withColumn("first_seen_at", F.when(i % 29 == 0, F.col("available_at") + F.expr("INTERVAL 1 SECOND"))
                     .otherwise(F.col("first_seen_at"))))
    return plain(d.select("record_id", F.array_join(violations(news_problems()), ",").alias("violations")))


@query
def news_rank(spark, sf):
    cutoff = F.lit("2024-01-02 06:00:00").cast("timestamp")
    d = tt.news_evidence(spark, sf).where(F.col("available_at") <= cutoff)
    return plain(news.revision_rank(d).select("source_key", "record_id", "revision", "rank"))


@query
def news_append(spark, sf):
    d = tt.news_evidence(spark, sf).drop("title")
    i = F.col("record_id").cast("bigint")
    have = d.where(i % 3 == 0)
    new = d.unionByName(d.where(i % 4 == 0).withColumn("revision", F.col("revision") + 1))
    return plain(news.append_items(have, new).select("record_id", "source_key", "revision", "available_at"))


@query
def asof_news_versions(spark, sf):
    """Per slot: how many current versions are in reach, and sums that identify them."""
    cols = ["record_id", "event_id", "available_at", "revision"]
    grid = slot_grid(slots(spark, sf), ["asset", "horizon"])
    v = news.visible_spans(grid, news.news_versions(tt.news_evidence(spark, sf).drop("title")), cols)
    return plain(slot_totals(v, grid, ["asset", "horizon"], "first", "last", {
        "n": F.lit(1), "revisions": F.col("revision"), "record_sum": F.col("record_id").cast("bigint")}, {"newest": F.col("available_at")}))


@query
def news_events(spark, sf):
    grid = slot_grid(slots(spark, sf), ["asset", "horizon"])
    v = news.visible_spans(grid, news.news_versions(tt.news_evidence(spark, sf).drop("title")), ["record_id", "event_id", "available_at"])
    return plain(slot_totals(news.event_spans(v), grid, ["asset", "horizon"], "first", "last", {
        "events": F.lit(1), "record_sum": F.col("record_id").cast("bigint")}, age_of="clock"))


@query
def news_neardup_pairs(spark, sf):
    """Pairs of distinct texts (by their lowest record) with Jaccard at or above the limit."""
    classes = cut_lineage(neardup.text_classes(tt.news_evidence(spark, sf), "body"))
    similar = neardup.similar_pairs(classes)
    first = classes.groupBy("class_id").agg(F.min(F.col("record_id").cast("bigint")).alias("rec"))
    a = first.withColumnRenamed("rec", "record_a")
    b = first.select(F.col("class_id").alias("other_id"), F.col("rec").alias("record_b"))
    return plain(similar.join(a, "class_id").join(b, "other_id").where("record_a < record_b")
                 .select("record_a", "record_b", "jaccard"))


@query
def news_neardup_kept(spark, sf):
    grid = slot_grid(slots(spark, sf), ["asset", "horizon"])
    d, _ = news.judged_texts(grid, tt.news_evidence(spark, sf), text_tables)
    kept = F.col("kept").cast("bigint")
    return plain(slot_totals(d, grid, ["asset", "horizon"], "first", "last", {
        "events": F.lit(1), "kept": kept, "kept_sum": kept * F.col("record_id").cast("bigint")}))


@query
def news_features(spark, sf):
    d = news_block(spark, sf)
    return plain(d.select("asset", "horizon", "cutoff_at", "news_active", *news.NEWS_SCALARS,
                          F.coalesce(F.col("news_event_count").cast("bigint"), F.lit(-1)).alias("lineage_size")))


@query
def news_lineage(spark, sf):
    """Records behind each active news block."""
    items = tt.news_evidence(spark, sf)
    grid = slot_grid(slots(spark, sf), ["asset", "horizon"])
    judged, classes = news.judged_texts(grid, items, text_tables)
    block = news.news_features(grid.drop("slot"), items, tt.news_polls(spark, sf), text_tables, news_rights(spark, sf), spans=(grid, judged, classes))
    return plain(news.news_lineage(block, judged, grid))


@query
def canonical_url(spark, sf):
    p = tt.read(spark, sf, "pages")
    spoilt = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("ftp://x.org/"), F.col("page_id"))) \
        .when(F.col("page_id") % 11 == 0, F.regexp_replace("url", "://", "://user@")) \
        .when(F.col("page_id") % 13 == 0, F.concat(F.regexp_extract("url", "^[^?#]*", 0),
                                                   F.lit("?b=2&UTM_Source=x&a=&fbclid=1&c"))) \
        .otherwise(F.col("url"))
    return plain(p.select("page_id", canonical(spoilt).alias("canonical_url")))


@query
def clean_title_query(spark, sf):
    """Whole document texts as titles; every ninth gets control characters."""
    d = tt.read(spark, sf, "documents").withColumn(
        "raw", F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("\x07\ta"), "text", F.lit("\x00\x1fz\n")))
        .otherwise(F.col("text")))
    t = clean("raw")
    return plain(d.select("doc_id", F.md5(t["title"]).alias("title_md5"), F.length(t["title"]).alias("chars"),
                          t["truncated"].alias("truncated")))


@query
def tfidf_score(spark, sf):
    docs = tt.read(spark, sf, "documents").select("doc_id", "text", "lang")
    model = textmodel.rule_weights(textmodel.build_vocabulary(docs, "text", docs.count()))
    return plain(textmodel.score(docs, model, "doc_id", "text", F.col("lang") == "en"))


@query
def text_model_gate(spark, sf):
    """One candidate model per (source, quality) of the labelled documents; sizes and rates are
    counted from the labels."""
    d = tt.read(spark, sf, "documents").join(tt.read(spark, sf, "labels"), "doc_id")
    m = (d.groupBy("source", "lang").agg(
        (F.count(F.lit(1)) * 400).alias("annotated_items"), (F.count(F.lit(1)) * 80).alias("holdout_items"),
        F.avg("quality").alias("sentiment_macro_f1"), (1.0 - F.avg("toxic")).alias("relevance_macro_f1"),
        (0.5 + F.avg("quality") / 2).alias("alpha"))
        .withColumn("approval_id", F.when(F.col("source") != "src3", F.concat(F.lit("ok-"), "source"))))
    return plain(textmodel.model_gate(m).select("source", "lang", "annotated_items", "holdout_items",
                                                "sentiment_macro_f1", "relevance_macro_f1", "approved"))


@query
def poll_windows(spark, sf):
    """Half-hour poll windows every quarter hour; a record counts once per window."""
    d = tt.news_evidence(spark, sf).select("asset", "record_id", "source_observed_at")
    w = d.withColumn("w", F.window("source_observed_at", "30 minutes", "15 minutes"))
    return plain(w.groupBy("asset", F.col("w.end").alias("polled_at")).agg(
        F.countDistinct("record_id").alias("records")))


@query
def macro_cpi_ingest(spark, sf):
    """Index payloads assembled from the orders, one JSON document per (source, series)."""
    o = tt.read(spark, sf, "orders")
    pri = F.substring("o_orderpriority", 1, 1)
    series = F.when(pri == "1", "CUSR0000SA0").when(pri == "2", "CUUR0000SA0L1E").otherwise(F.concat(F.lit("OTHER"), pri))
    rows = (o.groupBy(series.alias("series"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
            .agg(F.min_by("o_totalprice", "o_orderkey").alias("v")))
    text = (F.when((F.col("y") * 12 + F.col("m")) % 17 == 0, "").when((F.col("y") * 12 + F.col("m")) % 19 == 0, "n/a")
            .otherwise(F.col("v").cast("string")))
    monthly = rows.select("series", F.struct(
        F.col("y").cast("string").alias("year"), F.concat(F.lit("M"), F.lpad(F.col("m").cast("string"), 2, "0")).alias("period"),
        text.alias("value")).alias("d"))
    annual = rows.select("series", "y").distinct().select("series", F.struct(
        F.col("y").cast("string").alias("year"), F.lit("M13").alias("period"), F.lit("1").alias("value")).alias("d"))
    docs = (monthly.unionByName(annual).groupBy("series").agg(F.collect_list("d").alias("data"))
            .select(F.col("series").alias("payload_id"),
                    F.to_json(F.struct(F.struct(F.array(F.struct(F.col("series").alias("seriesID"), "data"))
                                                .alias("series")).alias("Results"))).alias("body"),
                    F.lit("2024-01-01 00:00:00").cast("timestamp").alias("acquired_at")))
    return plain(payloads.cpi_observations(docs).select(
        "series_id", "reference_period", "value", "mom_pct", "yoy_pct", "unit", "is_seasonally_adjusted",
        "source_record_key", "available_at"))


@query
def macro_h15_ingest(spark, sf):
    """Rate XML assembled from the orders: a namespaced document per month."""
    o = tt.read(spark, sf, "orders")
    pri = F.substring("o_orderpriority", 1, 1)
    series = (F.when(pri == "1", "RIFSPFF_N.B").when(pri == "2", "RIFLGFCY02_N.B").when(pri == "3", "RIFLGFCY10_N.B")
              .otherwise("RIFOTHER"))
    day = o.groupBy(series.alias("series"), F.to_date("o_orderdate").alias("d")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("v"))
    value = F.when(F.dayofmonth("d") % 11 == 0, "ND").otherwise((F.floor(F.col("v")) / 100).cast("string"))
    obs = F.concat(F.lit('<frb:Observation date="'), F.col("d").cast("string"), F.lit('" value="'), value, F.lit('"/>'))
    per = (day.withColumn("month", F.date_format("d", "yyyy-MM")).groupBy("month", "series")
           .agg(F.concat(F.lit('<frb:Series id="'), F.col("series"), F.lit('">'),
                         F.array_join(F.array_sort(F.collect_list(obs)), ""), F.lit("</frb:Series>")).alias("x")))
    docs = per.groupBy("month").agg(F.array_join(F.array_sort(F.collect_list("x")), "").alias("x")).select(
        F.col("month").alias("payload_id"),
        F.concat(F.lit('<frb:Data xmlns:frb="urn:rates">'), "x", F.lit("</frb:Data>")).alias("body"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("acquired_at"))
    return plain(payloads.rate_observations(docs).select("series_id", "reference_period", "value", "unit",
                                                         "source_record_key", "payload_id"))


@query
def news_ingest(spark, sf):
    """Article payloads of up to 250 pages each; every fifth asset document splits by page id."""
    p = tt.read(spark, sf, "pages")
    seen = F.date_format(F.expr(f"{tt.T0} + make_dt_interval(0, CAST(page_id % 720 AS INT), 0, 0)"), "yyyyMMdd'T'HHmmss'Z'")
    art = F.struct(
        F.when(F.col("page_id") % 31 == 0, F.concat(F.lit("mailto:"), "url")).otherwise(F.col("url")).alias("url"),
        F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"),
        F.when(F.col("page_id") % 37 == 0, "yesterday").otherwise(seen).alias("seendate"),
        F.upper(F.regexp_extract("url", "://([^/?#]+)", 1)).alias("domain"), F.lit("English").alias("language"))
    docs = (p.groupBy((F.floor(F.col("page_id") / 250)).alias("n"))
            .agg(F.to_json(F.struct(F.collect_list(art).alias("articles"))).alias("body"))
            .select(F.col("n").alias("payload_id"), F.lit("BTC").alias("asset"), "body",
                    F.lit("2024-01-25 00:00:00").cast("timestamp").alias("first_seen_at"),
                    F.lit("2024-01-25 00:00:05").cast("timestamp").alias("available_at")))
    good, bad = payloads.article_evidence(docs)
    keep = ["payload_id", "record_id", "url", "publisher", "source_observed_at", "title_truncated", "coverage_capped"]
    none = [F.lit(None).cast("string").alias("record_id"), "url", F.lit(None).cast("string").alias("publisher"),
            F.lit(None).cast("timestamp").alias("source_observed_at"), F.lit(False).alias("title_truncated"),
            F.lit(False).alias("coverage_capped")]
    return plain(good.select(*keep, F.lit("").alias("problem"))
                 .unionByName(bad.select("payload_id", *none, "problem")))


QUERIES["clean_title"] = QUERIES.pop("clean_title_query")
