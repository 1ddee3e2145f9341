"""Operator 11: interaction audit of five filters by wide packed counters.

A document's failures form a mask of five bits. Every mask has one wide integer: a 64-bit field for each of the 600 (order, step) pairs and
each outcome (kept after the step, removed by it, failing but removed before). Sums of such integers per part hold all counts at once; there
are fewer than 2^63 rows, so no field runs over into the next one. Three sums are taken: all documents, good ones and toxic ones.

Rows are counted per (part, mask, good, toxic) before anything is summed, so a part of any size is at most 128 numbers for the task that packs and
unpacks it. Filter E compares digests of whole texts: rows are first combined per (document, digest), then per digest, so a text with
a billion copies arrives at its task as a few partial rows.

Defined results: a null text is empty (fails A only); a null lang is the part ''; a row with a null id has no smaller id, is no one's
original and has no labels, but counts; repeated rows of an id count each, and none of them is another's original; a document is good (toxic)
if any of its labels says 1; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import batch_of, read

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 200, 50, 3
OUTCOMES = ("kept", "removed", "redundant")
FIELD_BYTES = 8
ORDERS = tuple(permutations(range(len(FILTERS))))
STEPS = tuple((order, step) for order in ORDERS for step in range(len(FILTERS)))
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def outcome(mask: int, order: tuple[int, ...], step: int) -> int | None:
    """Position in OUTCOMES of what a document with this mask meets at a step; None where it passes the filter but was removed before."""
    before, fails = any(mask >> f & 1 for f in order[:step]), mask >> order[step] & 1
    return (2 if before else 1) if fails else (None if before else 0)


def packed(mask: int) -> int:
    """The wide integer of one document: a 1 in the field of every outcome that it has."""
    fields = np.zeros((len(STEPS), len(OUTCOMES)), "<u8")
    for i, (order, step) in enumerate(STEPS):
        at = outcome(mask, order, step)
        if at is not None:
            fields[i, at] = 1
    return int.from_bytes(fields.tobytes(), "little")


def unpacked(total: int) -> np.ndarray:
    """The fields of a sum, shaped (steps, outcomes)."""
    raw = total.to_bytes(len(STEPS) * len(OUTCOMES) * FIELD_BYTES, "little")
    return np.frombuffer(raw, "<u8").reshape(len(STEPS), len(OUTCOMES)).astype(np.int64)


def text_failures(text: Column) -> Column:
    """Bits A to D of a whole text."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * upper > MOST_UPPER * F.length(text), text.rlike("[#$%&*|]"))
    bits = [F.when(fail, 1 << i).otherwise(0) for i, fail in enumerate(fails)]
    return sum(bits[1:], bits[0])


def mask_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): rows per combination; bit i of the mask is failure of filter i."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       text_failures(whole).alias("mask"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"))
    nameless = rows.where("doc_id is null").groupBy("part", "mask").agg(F.count("*").alias("n")).select(
        "part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n")

    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    single = rows.where("doc_id is not null").groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    marked = single.join(marks, "doc_id", "left").na.fill(False, ["good", "toxic"])
    per_text = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    original = F.min("first.doc_id").over(W.partitionBy("digest"))
    per_text = per_text.withColumn("originals", F.when(F.col("first.doc_id") == original, F.col("first.n")).otherwise(0))
    named = per_text.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask"), F.col("originals").alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))).alias("x")
    ).select("part", "x.mask", "good", "toxic", "x.n").where("n > 0")
    return named.unionByName(nameless).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from `mask_counts`; a part is at most 128 rows."""
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in COUNTS)])
    names = ["".join(FILTERS[f] for f in order) for order, _ in STEPS]
    steps = np.array([step + 1 for _, step in STEPS], np.int32)
    judge = np.array([order[step] for order, step in STEPS])

    def summed(group: pa.Table) -> pa.Table:
        wide, everything, good, toxic, alone = {}, 0, 0, 0, np.zeros(len(FILTERS), np.int64)
        for mask, g, t, n in zip(*(group[c].to_pylist() for c in ("mask", "good", "toxic", "n")), strict=True):
            if mask not in wide:
                wide[mask] = packed(mask)
            many = wide[mask] * n
            everything += many
            good += many if g else 0
            toxic += many if t else 0
            if mask and not mask & (mask - 1):
                alone[mask.bit_length() - 1] += n
        kept, removed, redundant = unpacked(everything).T
        share = np.array([removed[judge == f].sum() for f in range(len(FILTERS))])
        return pa.Table.from_batches([batch_of(schema, [group["part"][0].as_py()] * len(STEPS), names, steps, kept, removed, redundant, alone[judge],
                                               unpacked(good)[:, 1], unpacked(toxic)[:, 1], share[judge])])

    return counts.groupBy("part").applyInArrow(summed, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over `documents`, by language."""
    return audit(mask_counts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
e AS (SELECT doc_id, part, t, len(w) AS n, len(list_distinct(w)) AS u, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS caps,
             min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, count(*) AS n,
             CASE WHEN n < {LEAST_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * u < {LEAST_DISTINCT} * n THEN 2 ELSE 0 END
             + CASE WHEN 100 * caps > {MOST_UPPER} * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS mask
      FROM e LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(c, b)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e
      WHERE length(replace(a.c || b.c || c.c || d.c || e.c, a.c, '')) = 4 AND b.c NOT IN (c.c, d.c, e.c) AND c.c NOT IN (d.c, e.c) AND d.c <> e.c),
s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before FROM o, range(1, 6) AS r(step)),
c AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, bit,
             sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN good AND mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS good_lost,
             sum(CASE WHEN toxic AND mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS toxic_lost
      FROM (SELECT part, good, toxic, CAST(n AS BIGINT) AS n, CAST(mask AS INTEGER) AS mask FROM m), s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM c
"""
