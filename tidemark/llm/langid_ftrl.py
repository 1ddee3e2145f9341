"""Operator 5: language identification by multinomial logistic regression on TF-IDF character n-grams.

Features: 1- to 3-grams of the lower-case text with white space, digits and ASCII punctuation as one space, hashed to FEATURES
buckets; weight (1 + ln tf) · idf, rows of length 1. Document frequencies are counted over all training documents in
one distributed pass. The regression is trained by follow-the-regularised-leader (FTRL-proximal) with L1 and L2 penalties on a
bounded sample: up to SAMPLE documents of each language, those with the smallest hash of the id; a fifth of them is held back to
fit the temperature that calibrates the probabilities. Scoring is one narrow pass over all whole texts.

Only the document frequencies (FEATURES numbers), the counts of languages and the bounded sample reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import batch_of, crc, read, texts_of
from tidemark.session import cut_lineage

FEATURES = 1 << 14
SAMPLE = 1000       #: documents of each language that train and calibrate
SAMPLE_CHARS = 20_000_000   #: characters of the sample of each language
LONG = 20                   #: a document of more than 1/LONG of these characters is drawn after all shorter ones
ALPHA, BETA, L1, L2, EPOCHS, BATCH = 1.0, 1.0, 1e-4, 1e-4, 4, 32

_PIECE = 1 << 18
_AT_ONCE = 256
_TABLE = np.arange(128, dtype=np.uint32)
for _i in range(128):
    _TABLE[_i] = ord(chr(_i).lower()) if chr(_i).isalpha() else 32


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def gram_counts(text: str, features: int = FEATURES) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams of a whole text, in bounded memory."""
    total = np.zeros(features, dtype=np.int64)
    for at in range(0, len(text), _PIECE):
        # two characters of overlap: no n-gram across a cut is lost, and those inside it are counted once
        lead = min(at, 2)
        points = np.frombuffer(text[at - lead:at + _PIECE].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        points = np.where(points < 128, _TABLE[np.minimum(points, 127)], points).astype(np.uint64)
        lead = max(0, len(points) - (len(text[at:at + _PIECE]))) if lead else 0
        h = np.zeros(len(points), dtype=np.uint64)
        for n in (1, 2, 3):
            h = h[:len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1:] + np.uint64(n)
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            total += np.bincount(((mixed >> np.uint64(32)) % np.uint64(features)).astype(np.int64)[max(0, lead - n + 1):], minlength=features)
    return total


def tfidf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a row of length 1."""
    at = np.flatnonzero(counts)
    value = (1 + np.log(counts[at])) * idf[at]
    length = np.sqrt(value @ value)
    return at, value / length if length else value


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: Sequence[tuple[np.ndarray, np.ndarray]], target: np.ndarray, classes: int, features: int = FEATURES, alpha: float = ALPHA,
          beta: float = BETA, l1: float = L1, l2: float = L2, epochs: int = EPOCHS, batch: int = BATCH) -> np.ndarray:
    """Weights (features, classes) by FTRL-proximal with the mean gradient of each batch; the order is fixed by a seed."""
    z, n, w = (np.zeros((features, classes)) for _ in range(3))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = order[at:at + batch]
            used = np.unique(np.concatenate([rows[i][0] for i in part]))
            dense = np.zeros((len(part), len(used)))
            for r, i in enumerate(part):
                dense[r, np.searchsorted(used, rows[i][0])] = rows[i][1]
            p = softmax(dense @ w[used])
            p[np.arange(len(part)), target[part]] -= 1
            g = dense.T @ p / len(part)
            sigma = (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / alpha
            z[used] += g - sigma * w[used]
            n[used] += g * g
            zu = z[used]
            w[used] = np.where(np.abs(zu) <= l1, 0, -(zu - np.sign(zu) * l1) / ((beta + np.sqrt(n[used])) / alpha + l2))
    return w


def temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden section on its logarithm. One of n + 2 cases counts as mistaken, so
    a faultless sample does not claim certainty."""
    if not len(target) or logits.shape[1] < 2:
        return 1.0
    doubt = 1 / (len(target) + 2)
    goal = np.full(logits.shape, doubt / (logits.shape[1] - 1))
    goal[np.arange(len(target)), target] = 1 - doubt

    def loss(u: float) -> float:
        return -float(np.mean(np.sum(goal * np.log(softmax(logits / np.exp(u)) + 1e-300), axis=1)))

    a, b, r = np.log(0.01), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    """Scores texts; `langs` in alphabetical order."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, heat: float):
        self.langs, self.idf, self.weights, self.heat = langs, idf, weights, heat

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not has_letter(text):
            return "und", 0.0
        at, value = tfidf(gram_counts(text, len(self.idf)), self.idf)
        p = softmax(value @ self.weights[at] / self.heat)
        best = int(p.argmax())
        return self.langs[best], float(min(1.0, p[best]))


def fit(rows: DataFrame, features: int = FEATURES, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Model from training rows (doc_id, text, lang); rows without text or lang are not used."""
    rows = rows.where("text is not null and lang is not null and lang <> 'und'")
    schema = pa.schema([("bucket", pa.int32()), ("docs", pa.int64())])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, seen = 0, np.zeros(features + 1, dtype=np.int64)
        for b in batches:
            for t in texts_of(b.column(0)):
                seen[:-1] += gram_counts(t, features) > 0
                docs += 1
        seen[-1] = docs
        used = np.flatnonzero(seen)
        yield batch_of(schema, used.astype(np.int32), seen[used])

    seen = np.zeros(features + 1)
    for r in rows.select("text").mapInArrow(frequencies, "bucket int, docs bigint").groupBy("bucket").agg(F.sum("docs").alias("docs")).collect():
        seen[r["bucket"]] = r["docs"]   # at most features + 1 rows
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1

    shade = F.xxhash64(F.col("doc_id").cast("string"), F.length("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}   # one row per language
    if not counts:
        return Model([], idf, np.zeros((features, 0)), 1.0)
    # a first cut by the hash leaves about twice the sample, so few texts are moved; small languages pass whole
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 2.0 * (sample + 20) / n))])
    near = rows.withColumn("shade", shade).where((F.pmod("shade", F.lit(1_000_000)) / 1e6 <= share[F.col("lang")]))
    too_long = F.length("text") > sample_chars // LONG
    order = W.partitionBy("lang").orderBy(too_long, F.pmod("shade", F.lit(1_000_000)), "shade", "doc_id", "text")
    size = F.sum(F.length("text").cast("bigint")).over(order.rowsBetween(W.unboundedPreceding, 0))
    chosen = near.withColumn("rank", F.row_number().over(order)).withColumn("size", size).where(
        (F.col("rank") <= sample) & ((F.col("size") <= sample_chars) | (F.col("rank") == 1))).select("lang", "rank", "text")

    out = pa.schema([("lang", pa.string()), ("rank", pa.int32()), ("at", pa.binary()), ("value", pa.binary())])

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [tfidf(gram_counts(t, features), idf) for t in texts_of(b.column(2))]
            yield batch_of(out, b.column(0), b.column(1), [a.astype("<u4").tobytes() for a, _ in found], [v.astype("<f4").tobytes() for _, v in found])

    got = sorted(cut_lineage(chosen.mapInArrow(featurise, "lang string, rank int, at binary, value binary")).collect(),
                 key=lambda r: (r["rank"], r["lang"]))   # at most `sample` rows a language
    langs = sorted({r["lang"] for r in got})
    x = [(np.frombuffer(r["at"], "<u4").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(float)) for r in got]
    y = np.array([langs.index(r["lang"]) for r in got])
    held = np.array([r["rank"] % 5 == 0 for r in got])
    weights = train([v for v, h in zip(x, held, strict=True) if not h], y[~held], len(langs), features)
    logits = np.array([v @ weights[a] for (a, v), h in zip(x, held, strict=True) if h]).reshape(-1, len(langs))
    return Model(langs, idf, weights, temperature(logits, y[held]))


def predicted(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), one row per input row.

    Defined results: `und` with score 0 for a null or empty text, one without letters, or when no language was learned. Ties go to the first
    language in the alphabet; repeated rows each give a row; an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t) for t in texts_of(b.column(1))]
            yield batch_of(schema, b.column(0), [f[0] for f in found], [f[1] for f in found])

    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The documents whose language is told with a score of `least` or more; texts that are `und` go. All columns pass through."""
    @F.arrow_udf(T.DoubleType())
    def sure(texts: pa.Array) -> pa.Array:
        # some texts at a time: a batch is decoded piece by piece
        return pa.array([model.predict(t)[1] for at in range(0, len(texts), _AT_ONCE) for t in texts_of(texts.slice(at, _AT_ONCE))], pa.float64())

    return docs.where(sure(F.col(f"`{text}`").cast("string")) >= least)


def held_out(key: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id is never held out."""
    return F.coalesce(F.pmod(crc(key), F.lit(3)) == 1, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")


def op5_langid_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = read(spark, sf_dir, "documents")
    out = predicted(docs, fit(training_rows(docs)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
