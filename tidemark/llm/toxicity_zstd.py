"""Operator 6: toxicity by compression distance between zstandard dictionaries of toxic and of ordinary text.

A window is WINDOW neighbouring words (runs of letters, lower case). Because a dictionary match costs about three bytes, single
words of four or five letters could not be told apart by their raw bytes; so every word is written as a 32-byte code (a
digest), which no ordinary match shortens. One dictionary is trained on toxic documents and two on disjoint halves of ordinary
ones. A window's gain is its shorter length with an ordinary dictionary less its length with the toxic dictionary. Windows with a
gain of at least a calibrated threshold are toxic; a logistic regression on their number and their share, fitted on
documents that trained no dictionary, gives the score. Scoring is one narrow pass over whole texts.

Bounds: at most SAMPLE labelled documents of each class (those with the smallest hash of the id) and SAMPLE_CHARS characters of each
class; two thirds train dictionaries, one third calibrates. Each dictionary is trained in one task from its part of the sample; the
driver receives the dictionaries and a few counts for each calibrating document. Word codes of fewer than MIN_DOCS documents of a part are left out.

Defined results: a null or empty text scores like one without toxic windows. A document with contradictory labels counts as
toxic. Without labels of both classes every score is the share of toxic labels (0 without any). Repeated rows each give a row; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import batch_of, crc, read, texts_of
from tidemark.session import cut_lineage

WINDOW = 1
SAMPLE, SAMPLE_CHARS = 6000, 30_000_000
LONG = 20   #: a text of more than 1/LONG of these characters counts after all shorter ones
TOXIC_BYTES, ORDINARY_BYTES = 1 << 16, 1 << 20
MIN_DOCS = 4
CODE = 32
THRESHOLDS = (4, 8, 12, 16, 20)
LEVEL = 19

_WORDS = re.compile(r"[^\W\d_]+").findall
_REMEMBERED = 400_000   #: windows whose gain a worker remembers


def code(window: str) -> bytes:
    return b"".join(hashlib.blake2b(w.encode(), digest_size=CODE).digest() for w in window.split(" "))


def windows(text: str, size: int = WINDOW) -> list[str]:
    found = _WORDS(text.lower())
    if size == 1:
        return found
    return [" ".join(found[i:i + size]) for i in range(0, max(1, len(found) - size + 1))] if found else []


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where the samples are too few to train one, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples, k=CODE, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _compressor(content: bytes):
    kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO)
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=CODE, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    return zstandard.ZstdCompressor(dict_data=kept, compression_params=params).compress


class Gains(dict):
    """Window -> gain, remembered."""

    def __init__(self, toxic: bytes, ordinary: tuple[bytes, ...]):
        self.toxic, self.ordinary = _compressor(toxic), [_compressor(o) for o in ordinary]

    def __missing__(self, window: str) -> int:
        raw = code(window)
        length = len(self.toxic(raw))
        # where the toxic dictionary does not shorten the code there is no gain to measure
        gain = min(len(o(raw)) for o in self.ordinary) - length if length < len(raw) else 0
        if len(self) >= _REMEMBERED:
            self.clear()
        self[window] = gain
        return gain


@lru_cache(maxsize=2)
def gains(toxic: bytes, ordinary: tuple[bytes, ...]) -> Gains:
    return Gains(toxic, ordinary)


def _features(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(n)), np.minimum(n, 3), np.log1p(n), 100 * n / np.maximum(total, 25)], axis=1).astype(float)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps: coefficients and mean loss."""
    b = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ b)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ b, -30, 30))), 1e-9, 1 - 1e-9)
    return b, float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


class Model:
    """Dictionaries, gain threshold and coefficients."""

    def __init__(self, toxic: bytes, ordinary: tuple[bytes, ...], threshold: int, coefficients: np.ndarray, size: int):
        self.toxic, self.ordinary, self.threshold, self.coefficients, self.size = toxic, ordinary, threshold, coefficients, size

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.toxic:
            return np.full(len(texts), self.coefficients[0])
        gain, least = gains(self.toxic, self.ordinary).__getitem__, self.threshold
        n, total = [], []
        for t in texts:
            found = windows(t, self.size) if t else []
            n.append(sum(map(least.__le__, map(gain, found))))
            total.append(len(found))
        z = _features(np.array(n, float), np.array(total, float)) @ self.coefficients
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, size: int = WINDOW, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Model from documents (doc_id, text) and labels (doc_id, toxic); the caller has left out what must not be learned."""
    named = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    named = named.withColumn("shade", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40)))
    count = {r["toxic"]: r["n"] for r in named.groupBy("toxic").agg(F.count("*").alias("n")).collect() if r["toxic"] in (0, 1)}
    if len(count) < 2:
        return Model(b"", (), 0, np.array([float(1 in count)]), size)
    share = {c: min(1.0, 1.5 * (sample + 50) / n) for c, n in count.items()}
    near = named.where(F.col("shade") < (1 << 40) * F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    order = W.partitionBy("toxic").orderBy("shade", "doc_id")
    ids = cut_lineage(near.where("toxic in (0, 1)").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample))
    ids = ids.select("doc_id", "toxic", "rank")   # at most 2 · sample rows, so their broadcast is bounded
    rows = docs.where("text is not null").join(F.broadcast(ids), "doc_id")
    too_long = F.length("text") > sample_chars // LONG
    chars = F.sum(F.length("text").cast("bigint")).over(
        W.partitionBy("toxic").orderBy(too_long, "rank", "text").rowsBetween(W.unboundedPreceding, 0))
    rows = cut_lineage(rows.select("toxic", "rank", "text").withColumn("chars", chars).where(F.col("chars") <= sample_chars).drop("chars"))

    def trained(group: pd.DataFrame) -> pd.DataFrame:
        toxic = int(group["toxic"].iloc[0])
        seen = [sorted(set(windows(t, size))) for t in group.sort_values(["rank", "text"])["text"]]
        often = Counter(w for s in seen for w in s)
        samples = [b"".join(map(code, (w for w in s if often[w] >= MIN_DOCS))) for s in seen]
        content = dictionary([s for s in samples if s], TOXIC_BYTES if toxic else ORDINARY_BYTES)
        return pd.DataFrame({"toxic": [toxic], "part": [int(group["part"].iloc[0])], "content": [content]})

    part = F.when((F.col("toxic") == 1) & (F.col("rank") % 3 == 1), 0).otherwise(F.col("rank") % 3)
    made = rows.withColumn("part", part.cast("int")).where("part < 2").groupBy("toxic", "part").applyInPandas(
        trained, "toxic int, part int, content binary").collect()   # three dictionaries
    toxic = next((r["content"] for r in made if r["toxic"] == 1), b"")
    ordinary = tuple(r["content"] for r in sorted(made, key=lambda r: r["part"]) if r["toxic"] == 0)
    if len(toxic) < CODE or not ordinary or min(map(len, ordinary)) < CODE:
        return Model(b"", (), 0, np.array([count[1] / (count[0] + count[1])]), size)

    schema = pa.schema([("toxic", pa.int32()), ("total", pa.int64()), ("counts", pa.list_(pa.int64()))])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = gains(toxic, ordinary).__getitem__
        for b in batches:
            found = [windows(t, size) for t in texts_of(b.column(1))]
            values = [np.fromiter(map(gain, f), dtype=np.int64, count=len(f)) for f in found]
            yield batch_of(schema, b.column(0), [len(f) for f in found], [[int((v >= t).sum()) for t in THRESHOLDS] for v in values])

    got = rows.where("rank % 3 = 2").select("toxic", "text").mapInArrow(counted, "toxic int, total bigint, counts array<bigint>").collect()
    if not got:
        return Model(b"", (), 0, np.array([count[1] / (count[0] + count[1])]), size)
    y, total = np.array([r["toxic"] for r in got], float), np.array([r["total"] for r in got], float)
    n = np.array([r["counts"] for r in got], float)
    fits = [(*_logistic(_features(n[:, i], total), y), t) for i, t in enumerate(THRESHOLDS)]
    coefficients, _, threshold = min(fits, key=lambda f: f[1])
    return Model(toxic, ordinary, threshold, coefficients, size)


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score), one row per input row."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch_of(schema, b.column(0), model.score(texts_of(b.column(1))))

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")


def held_out(key: Column) -> Column:
    """crc32 of the id as text is divisible by 5; a null id is never held out."""
    return F.coalesce(F.pmod(crc(key), F.lit(5)) == 0, F.lit(False))


def op6_toxicity_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit(docs.select("doc_id", "text"), labels.where(~held_out(F.col("doc_id"))))
    out = scored(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
