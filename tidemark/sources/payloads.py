"""Landed provider payloads to typed rows. One row per payload document comes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import ARTICLES_PER_POLL, CPI_SERIES, RATE_SERIES
from tidemark.functions.text import canonical_url, clean_title, compose_nfc
from tidemark.operators.macro import with_changes

CPI_SCHEMA = ("struct<Results:struct<series:array<struct<seriesID:string,"
              "data:array<struct<year:string,period:string,value:string>>>>>>")
XML_SCHEMA = ("struct<Series:array<struct<_id:string,"
              "Observation:array<struct<_date:string,_value:string>>>>>")
ARTICLE_SCHEMA = "struct<articles:array<struct<url:string,title:string,seendate:string,domain:string,language:string>>>"


def map_literal(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def canonical_digest(*parts: Column) -> Column:
    """SHA-256 of the fields in fixed order; a missing field is an empty part."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def cpi_observations(payloads: DataFrame) -> DataFrame:
    """payloads(payload_id, body, acquired_at) to monthly index observations.

    Annual averages (period M13) and unknown series are dropped. Changes use row offsets 1 and
    12 inside one payload and are taken before empty or unreadable values are dropped.
    """
    rows = (payloads
            .select("payload_id", "acquired_at", F.sha2("body", 256).alias("raw_digest"),
                    F.explode(F.from_json("body", CPI_SCHEMA)["Results"]["series"]).alias("s"))
            .select("payload_id", "acquired_at", "raw_digest", F.col("s.seriesID").alias("source_series"),
                    F.explode("s.data").alias("d"))
            .where(F.col("source_series").isin(*CPI_SERIES) & (F.col("d.period") != "M13"))
            .select("payload_id", "acquired_at", "raw_digest", "source_series",
                    F.concat_ws("-", "d.year", "d.period").alias("reference_period"),
                    F.expr("try_cast(d.value AS DOUBLE)").alias("value")))
    changed = with_changes(rows, by=["payload_id", "source_series"], order=["reference_period"])
    series = map_literal({k: v[0] for k, v in CPI_SERIES.items()})[F.col("source_series")]
    adjusted = F.col("source_series").isin(*[k for k, v in CPI_SERIES.items() if v[1]])
    return changed.select(
        series.alias("series_id"), "reference_period", "value", "mom_pct", "yoy_pct",
        F.lit("INDEX").alias("unit"), adjusted.alias("is_seasonally_adjusted"),
        F.concat_ws(":", "source_series", "reference_period").alias("source_record_key"),
        F.col("acquired_at").alias("available_at"), "raw_digest", "payload_id",
        canonical_digest(series, F.col("reference_period"), F.col("value")).alias("canonical_digest"))


def rate_observations(payloads: DataFrame) -> DataFrame:
    """payloads(payload_id, body, acquired_at) of rate XML, any namespace, to daily observations."""
    doc = F.from_xml(F.col("body"), XML_SCHEMA, {"attributePrefix": "_", "ignoreNamespace": "true"})
    rows = (payloads
            .select("payload_id", "acquired_at", F.sha2("body", 256).alias("raw_digest"),
                    F.explode(doc["Series"]).alias("s"))
            .select("payload_id", "acquired_at", "raw_digest", F.col("s._id").alias("source_series"),
                    F.explode("s.Observation").alias("o"))
            .where(F.col("source_series").isin(*RATE_SERIES))
            .select("payload_id", "acquired_at", "raw_digest", "source_series",
                    F.col("o._date").alias("reference_period"),
                    F.expr("try_cast(o._value AS DOUBLE)").alias("value"))
            .where("value IS NOT NULL AND reference_period <> ''"))
    return rows.select(
        map_literal(RATE_SERIES)[F.col("source_series")].alias("series_id"), "reference_period", "value",
        F.lit("PERCENT").alias("unit"),
        F.concat_ws(":", "source_series", "reference_period").alias("source_record_key"),
        F.col("acquired_at").alias("available_at"), "raw_digest", "payload_id")


def etf_table_cells(rows: DataFrame) -> DataFrame:
    """rows(asset_id, table_id, row_no, cells array<string>) to long cells for `etf.reconcile`.

    Row 0 is the header: date, fund tickers, and a column named total. Dates are ISO or
    `04 Sep 2026`; rows with other dates are skipped. A short row gives NULL texts.
    """
    head = (rows.where("row_no = 0")
            .select("asset_id", "table_id", F.posexplode("cells").alias("pos", "name"))
            .select("asset_id", "table_id", "pos", F.trim("name").alias("name"))
            .where("pos > 0 AND name <> ''"))
    funds = head.where("lower(name) <> 'total'").select("asset_id", "table_id", "pos", F.col("name").alias("fund_id"))
    total = head.where("lower(name) = 'total'").groupBy("asset_id", "table_id").agg(F.max("pos").alias("total_pos"))
    day = F.trim(F.col("cells")[0])
    iso = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr("try_to_date(trim(cells[0]), 'yyyy-MM-dd')"))
    body = (rows.where("row_no > 0 AND size(cells) > 0")
            .withColumn("session_date", F.coalesce(
                iso, F.when(day.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4}$"), F.expr("try_to_date(trim(cells[0]), 'd MMM yyyy')"))))
            .where("session_date IS NOT NULL"))
    d = body.join(total, ["asset_id", "table_id"], "left").join(funds, ["asset_id", "table_id"])
    return d.select("asset_id", "session_date", "fund_id", F.expr("get(cells, pos)").alias("value_text"),
                    F.expr("get(cells, total_pos)").alias("total_text"))


def article_evidence(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """payloads(payload_id, asset, body, first_seen_at, available_at) to (evidence, quarantine).

    Required text fields, http(s) URLs, observation not after first sight. A payload of exactly
    250 articles is flagged as capped; more than 250 is quarantined as a whole.
    """
    rows = (payloads
            .withColumn("_a", F.from_json("body", ARTICLE_SCHEMA)["articles"])
            .withColumn("_n", F.size("_a"))
            .select("payload_id", "asset", "first_seen_at", "available_at", "_n", F.explode("_a").alias("a")))
    title = clean_title(compose_nfc(F.col("a.title")))
    observed = F.try_to_timestamp(F.col("a.seendate"), F.lit("yyyyMMdd'T'HHmmss'Z'"))
    d = rows.select(
        "payload_id", "asset", "first_seen_at", "available_at", "_n",
        canonical_url("a.url").alias("url"), F.lower("a.domain").alias("publisher"),
        title["title"].alias("title"), title["truncated"].alias("title_truncated"),
        observed.alias("source_observed_at"), F.coalesce("a.language", F.lit("UNKNOWN")).alias("language"),
        F.col("a.title").alias("_raw_title"))
    problem = (F.when(F.col("_n") > ARTICLES_PER_POLL, "too_many_articles")
               .when(F.col("url").isNull(), "url")
               .when(F.coalesce("_raw_title", F.lit("")) == "", "title")
               .when(F.coalesce("publisher", F.lit("")) == "", "domain")
               .when(F.col("source_observed_at").isNull(), "seendate")
               .when(F.col("source_observed_at") > F.col("first_seen_at"), "future"))
    d = d.withColumn("problem", problem)
    iso = F.date_format("source_observed_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    good = (d.where("problem IS NULL")
            .withColumn("record_id", F.sha2(F.concat_ws("\n", "asset", "url", "title", iso), 256))
            .withColumn("source_key", F.col("url"))
            .withColumn("revision", F.unix_micros("source_observed_at"))
            .withColumn("event_id", F.sha2("url", 256))
            .withColumn("coverage_capped", F.col("_n") == ARTICLES_PER_POLL)
            .drop("_n", "_raw_title", "problem"))
    return good, d.where("problem IS NOT NULL").select("payload_id", "url", "problem")


def merge_windows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two halves of a split poll window; capped when either half was."""
    both = left.unionByName(right)
    flag = both.groupBy("asset").agg(F.bool_or("coverage_capped").alias("coverage_capped"))
    return both.drop("coverage_capped").join(flag, "asset")
