"""Operator 13: maximal periodic runs of words by longest common extensions.

A run is a stretch of words with smallest period q and at least max(LEAST, 2q) words that cannot be extended at either side. Its Lyndon root
starts somewhere inside it and is the longest Lyndon word there in one of the two orders of the alphabet. So every place gives two candidates: the
distances to the next smaller and to the next greater suffix. Suffix ranks come from the tree of the text; a candidate (place, period) is
extended forwards by the tree of the text and backwards by that of its reversal, and is a run if both extensions together cover one more period.

Trees are built only where a run can lie. Every word of a run lies in some GRAM consecutive words that occur again at most a period away inside the run, and
a period is at most half of its stretch. Words without this property are cut away until nothing changes; each remaining stretch has its own two trees.
A run never reaches beyond its stretch, so no run is lost (proof by the property itself: all words of a run have it).

One narrow pass, no shuffle. Words are numbered exactly per document; hashes of GRAM numbers only choose stretches, and a collision could only add one.
Memory grows with the longest periodic stretch of a single document. Defined results: a null text has no words; repeated rows give their rows again; a null
key stays null; ties for the greatest length go to the smallest start, then period; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bytes_of, crc, read
from tidemark.llm.suffix_tree import Extensions
from tidemark.llm.words import mix

LEAST = 12
GRAM = LEAST // 2   #: a run of LEAST words or more and two periods repeats that many words a period later
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class _Numbers(dict):
    """Word -> its number from 1, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def stretches(ids: np.ndarray, least: int = LEAST, gram: int = GRAM) -> list[tuple[int, int]]:
    """Parts (from, to) of the text that hold all of its runs."""
    n = len(ids)
    if n < least:
        return []
    grams = np.zeros(n - gram + 1, dtype=np.uint64)
    words = mix(ids.astype(np.uint64))
    for k in range(gram):
        grams = grams * _BASE + words[k:n - gram + 1 + k]
    at, hash_ = np.arange(len(grams)), mix(grams)
    lo, hi, before = np.array([0]), np.array([n]), n + 1
    while len(lo):
        part = np.searchsorted(lo, at, side="right") - 1
        inside = (part >= 0) & (at + gram <= hi[np.maximum(part, 0)])
        at, part = at[inside], part[inside]
        h = hash_[at]
        order = np.lexsort((at, h)) if len(lo) == 1 else np.lexsort((at, h, part))
        same = (h[order][1:] == h[order][:-1]) & (part[order][1:] == part[order][:-1])
        apart = at[order][1:] - at[order][:-1]
        same &= 2 * apart <= (hi - lo)[part[order][1:]]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        at = at[again]
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + gram, -1)
        edges = np.diff((np.cumsum(cover[:n]) > 0).astype(np.int8), prepend=0, append=0)
        lo, hi = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        long = hi - lo >= least
        lo, hi = lo[long], hi[long]
        total = int((hi - lo).sum())
        if total == before:
            break
        before = total
    return list(zip(lo.tolist(), hi.tolist(), strict=True))


def _next_smaller(rank: list[int]) -> list[int]:
    """For every place the next place of smaller rank; the length where there is none."""
    out, stack = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def _stretch_runs(ids: np.ndarray, least: int) -> np.ndarray:
    """(start, length, period) of the runs of a stretch."""
    n = len(ids)
    ids = np.unique(ids, return_inverse=True)[1] + 1
    forward, backward = Extensions(ids), Extensions(ids[::-1])
    rank = forward.rank
    root = np.concatenate([np.arange(n + 1)] * 2)
    other = np.concatenate([_next_smaller(rank.tolist()), _next_smaller((-rank).tolist())])
    inside = other < n
    root, other = root[inside], other[inside]
    period = other - root
    ahead, back = forward.common(root, other), backward.common(n - root, n - other)
    length = period + ahead + back
    long = (length >= 2 * period) & (length >= least)
    return np.stack([root - back, length, period], axis=1)[long]


def runs(ids: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of all runs of a text of word numbers, by start, then period."""
    found = [_stretch_runs(ids[lo:hi], least) + [lo, 0, 0] for lo, hi in stretches(ids, least, least // 2)]
    if not found:
        return np.empty((0, 3), np.int64)
    every = np.unique(np.concatenate(found), axis=0)
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """True for the words that no run contains after its first period."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, found[:, 0] + found[:, 2], 1)
    np.add.at(cover, found[:, 0] + found[:, 1], -1)
    return np.cumsum(cover)[:n] == 0


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs by start, then period, and the kept words joined by one space."""
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run_type)), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, every, collapsed = [], [], []
            for raw in bytes_of(b.column(1)):
                words = (raw or b"").split()   # bytes are split at 0x20 and 0x09-0x0D only
                numbers = _Numbers()
                found = runs(np.array(list(map(numbers.__getitem__, words)), np.int64), least)
                if len(found):
                    words = [words[i] for i in np.flatnonzero(kept_words(len(words), found)).tolist()]
                    counts.append(len(raw.split()))
                else:
                    counts.append(len(words))
                every.append(found)
                collapsed.append(b" ".join(words))
            flat = np.concatenate(every) if every else np.empty((0, 3), np.int64)
            offsets = pa.array(np.cumsum([0, *map(len, every)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, c], pa.int64()) for c in range(3)], fields=list(run_type)))
            yield pa.record_batch([b.column(0), pa.array(counts, pa.int64()), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], schema=schema)

    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string")


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, chosen by a hash of the id, repeat a stretch of their words to the end."""
    words = F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+"), "")
    chosen = F.coalesce(F.col("h") % 10 == 0, F.lit(False)) & (F.size("w") > 0)
    g, n = F.floor(F.col("h") / 10), F.size("w").cast("bigint")
    marked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), crc(F.col("doc_id").cast("bigint")).alias("h"))
    marked = marked.withColumn("w", F.when(F.col("h") % 10 == 0, words).otherwise(F.array()))
    marked = marked.withColumn("a", F.when(chosen, g % n)).withColumn("p", F.when(chosen, 1 + F.floor((n - F.col("a")) / (3 + g % 8))))
    repeated = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.element_at(
        "w", 1 + F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return marked.select("doc_id", F.when(chosen, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, the longest one spelt out, digests of all and of the text without repetitions."""
    found = periodic_runs(with_periods(read(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("q"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.q")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.q")).cast("bigint").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
