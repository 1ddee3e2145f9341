"""Frozen TF-IDF scorer with linear softmax heads, and its admission gate."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.constants import TEXT_GATE, TEXT_HEADS
from tidemark.functions.numeric import softmax
from tidemark.functions.text import bind, long_words
from tidemark.session import cut_lineage, small_side, spread

HEAD_CLASSES = [(h, c) for h, classes in TEXT_HEADS.items() for c in classes]
MAX_VOCABULARY = 20000
BUCKETS = 1 << 20         #: counters that bound the totals of terms
SHARE = 64                #: one in so many terms is counted to guess where the vocabulary ends
WORDS_AT_ONCE = 500_000


def terms(text: Column | str) -> Column:
    """Words of two or more characters and their neighbouring pairs."""
    def pairs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.concat(F.get(w, i - 1), F.lit(" "), F.get(w, i)))
        return F.when(F.size(w) >= 2, F.concat(w, each)).otherwise(w)
    return bind(long_words(text), pairs)


def frequent(docs: DataFrame, text: str, size: int) -> DataFrame:
    """term, total and df of the terms that may be among the `size` most frequent.

    Occurrences are counted in BUCKETS by hash, which bounds every term's total from above. A share of the terms, counted by itself in the same pass,
    suggests a total `least`. If `size` terms or more reach it, no term of a smaller bucket can be among them; else `least` falls, at last to nothing. The result is
    the same whatever was suggested.
    """
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).alias("_b")
    named = F.when(F.pmod(F.xxhash64("term", F.lit(1)), F.lit(SHARE)) == 0, F.col("term")).alias("term")
    counted = cut_lineage(docs.select(F.explode(terms(text)).alias("term")).select(bucket, named).groupBy("_b", "term").agg(F.count(F.lit(1)).alias("n")))
    some = counted.where("term IS NOT NULL").orderBy(F.col("n").desc()).limit(max(1, size * 5 // (SHARE * 4))).select("n").collect()
    least = some[-1]["n"] if len(some) == max(1, size * 5 // (SHARE * 4)) else 0
    both = bind(terms(text), lambda t: F.concat(F.transform(t, lambda x: F.struct(x.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df"))),
                                                F.transform(F.array_distinct(t), lambda x: F.struct(x.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df")))))
    every = docs.select(F.explode(both).alias("e")).select("e.*")
    tally = [F.sum("tf").alias("total"), F.sum("df").alias("df")]
    while least > 1:
        full = small_side(cut_lineage(counted.groupBy("_b").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("_b")), BUCKETS)
        found = cut_lineage(every.withColumn("_b", bucket).join(full, "_b", "left_semi").groupBy("term").agg(*tally).where(F.col("total") >= least))
        if found.count() >= size:
            return found
        least //= 4
    return every.groupBy("term").agg(*tally)


def build_vocabulary(docs: DataFrame, text: str, documents: int, size: int = MAX_VOCABULARY) -> DataFrame:
    """The most frequent terms (ties by term) with rank and idf = ln((1+N)/(1+df)) + 1. Terms that can be no candidates by the counts of their buckets are not shuffled."""
    return (frequent(spread(docs), text, size).orderBy(F.col("total").desc(), "term").limit(size)
            .agg(F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("neg"), "term", "df"))).alias("v"))
            .select(F.posexplode("v").alias("rank", "v"))
            .select(F.col("v.term").alias("term"), "rank",
                    (F.log((1.0 + documents) / (1.0 + F.col("v.df"))) + 1.0).alias("idf")))


def rule_weights(vocabulary: DataFrame) -> DataFrame:
    """Weights of the demonstration model: ((3·rank + 5·head + 7·class) mod 7 − 3) / 10."""
    cells = []
    for h, (head, classes) in enumerate(TEXT_HEADS.items()):
        for c, _ in enumerate(classes):
            cells.append(((F.col("rank") * 3 + h * 5 + c * 7) % 7 - 3) / F.lit(10.0))
    return vocabulary.withColumn("w", F.array(*cells))


def weighed(model: pa.Table) -> Callable[[Column], Column]:
    """Per list of words: the sum of squares and the weighted sums of x = (1 + ln tf)·idf over the known terms."""
    known, idf = model["term"].combine_chunks(), model["idf"].to_numpy()
    w = np.array(model["w"].to_pylist(), float).reshape(len(idf), len(HEAD_CLASSES))

    def sums(lists: pa.Array) -> np.ndarray:
        words, row = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        pairs = pc.binary_join_element_wise(words[:-1], words[1:], " ") if len(words) else words
        place = lambda t: pc.fill_null(pc.index_in(t, value_set=known), -1).to_numpy()
        term = np.concatenate([place(words), np.where(row[:-1] == row[1:], place(pairs), -1)])
        at = np.concatenate([row, row[:-1]])[term >= 0] * len(idf) + term[term >= 0]
        at, tf = np.unique(at, return_counts=True)
        row, term = at // max(len(idf), 1), at % max(len(idf), 1)
        x = (1.0 + np.log(tf)) * idf[term]
        return np.stack([np.bincount(row, v, len(lists)) for v in (x * x, *(x[:, None] * w[term]).T)], axis=1)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(lists: pa.Array) -> pa.Array:
        edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        cuts = np.flatnonzero(np.diff(edges[:-1] // WORDS_AT_ONCE, prepend=-1)).tolist()   # rows that are weighed together
        parts = [sums(lists[i:j]) for i, j in zip(cuts, [*cuts[1:], len(lists)], strict=True)]
        flat = np.concatenate(parts) if parts else np.empty((0, 1 + len(HEAD_CLASSES)))
        return pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), flat.shape[1]).cast(pa.list_(pa.float64()))

    return run


def score(docs: DataFrame, model: DataFrame, key: str, text: str, english: Column) -> DataFrame:
    """sentiment, relevance_btc, relevance_eth and status per document.

    `model` holds (term, idf, w[]) and at most 20,000 terms; that bound is checked before tasks are
    told of it. A text is scored where it is read. Texts of one key count as one; only these are shuffled, by their known terms. Texts in another language
    score zero with no status; texts without a key or without known terms score by the intercepts (zero).
    """
    model = cut_lineage(model)
    if model.limit(MAX_VOCABULARY + 1).count() > MAX_VOCABULARY:
        raise ValueError("vocabulary exceeds its limit")
    names = ["_sq", *[f"_z{i}" for i in range(len(HEAD_CLASSES))]]
    often = small_side(cut_lineage(docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(key)))
    words = F.coalesce(long_words(text), F.array().cast("array<string>"))
    lone = spread(docs).join(often, key, "left_anti").withColumn("_s", F.when(F.col(key).isNotNull(), weighed(model.toArrow())(words)))
    lone = lone.select(*docs.columns, *[F.get("_s", F.lit(i)).alias(n) for i, n in enumerate(names)])
    several = docs.join(often, key, "left_semi")
    counts = several.select(key, F.explode(terms(text)).alias("term")).join(F.broadcast(model.select("term")), "term").groupBy(key, "term").agg(
        F.count(F.lit(1)).alias("tf")).join(F.broadcast(model), "term").withColumn("_x", (1.0 + F.log("tf")) * F.col("idf"))
    sums = counts.groupBy(key).agg(F.sum(F.col("_x") * F.col("_x")).alias("_sq"),
                                   *[F.sum(F.col("_x") * F.col("w")[i]).alias(f"_z{i}") for i in range(len(HEAD_CLASSES))])
    d = lone.unionByName(several.join(sums, key, "left").select(lone.columns)).withColumn("_norm", F.nullif(F.sqrt("_sq"), F.lit(0.0)))
    z = {hc: F.coalesce(F.col(f"_z{i}") / F.col("_norm"), F.lit(0.0)) for i, hc in enumerate(HEAD_CLASSES)}
    p = {h: softmax([z[(h, c)] for c in classes]) for h, classes in TEXT_HEADS.items()}
    status = F.lit(None).cast("string")
    best = F.greatest(*[z[("status", c)] for c in TEXT_HEADS["status"]])
    for c in reversed(TEXT_HEADS["status"]):
        status = F.when(z[("status", c)] == best, F.lit(c)).otherwise(status)
    zero = F.lit(0.0)
    return d.select(
        key, F.when(english, p["sentiment"][2] - p["sentiment"][0]).otherwise(zero).alias("sentiment"),
        F.when(english, p["BTC"][1]).otherwise(zero).alias("relevance_btc"),
        F.when(english, p["ETH"][1]).otherwise(zero).alias("relevance_eth"),
        F.when(english, status).alias("status"))


def model_gate(metrics: DataFrame) -> DataFrame:
    """Add `approved`: sizes and scores reach their floors, scores lie in [0, 1], approval is named."""
    ok = F.coalesce(F.col("approval_id"), F.lit("")) != ""
    for name, floor in TEXT_GATE.items():
        c = F.col(name)
        ok = ok & (c >= floor)
        if not name.endswith("items"):
            ok = ok & c.between(0, 1)
    return metrics.withColumn("approved", F.coalesce(ok, F.lit(False)))
