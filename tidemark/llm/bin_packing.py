"""Operator 10: best-fit packing into sequences of several permitted lengths.

Items (documents, or pieces of documents longer than the largest length) are dealt into shards by a hash, about
`shard_items` each, so that every shard is packed in one task with bounded memory, however items are
distributed over sources or sizes. In a shard items go from long to short into the open bin with the least
room that still holds them (best fit). If none does, a bin opens. For each permitted length that holds the item, the bin is filled in thought from the histogram
of the sizes that are left, largest first, and shrunk to its contents; the length with the smallest (shrunk length + overhead) / tokens opens. So all lengths are
weighed against what the shard can really put into them. The shard is also packed with each length as the fixed opening length, and the packing of
the least total cost (lengths plus overhead) is kept. At the end each bin shrinks to the smallest permitted length that holds its contents.

Defined results: items of length null or below 1 make no piece; repeated rows are separate items; ties go by key, then by
piece; an empty table gives an empty result; only `key` and `size` are read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read
from tidemark.llm.token_spans import token_counts
from tidemark.session import cut_lineage

LENGTHS = (512, 1024, 2048, 4096, 8192)
SHARD_ITEMS = 10_000
OVERHEAD = 16   #: cost of a sequence beside its length, in tokens

SCHEMA = "shard int, bin int, capacity int, used int, place int, doc_id bigint, piece int, piece_start bigint, size int"


class Left:
    """Sizes that are not packed yet, as a histogram."""

    def __init__(self, sizes: Sequence[int]):
        counted = Counter(sizes)
        self.sizes = sorted(counted)
        self.counts = [counted[s] for s in self.sizes]

    def take(self, size: int) -> None:
        at = bisect_left(self.sizes, size)
        self.counts[at] -= 1
        if not self.counts[at]:
            del self.sizes[at], self.counts[at]

    def fill(self, room: int) -> int:
        """What the largest sizes that still fit, one after the other, would fill of a room."""
        used, at = 0, len(self.sizes)
        while at and room - used >= self.sizes[0]:
            at = bisect_right(self.sizes, room - used, 0, at) - 1
            if at < 0:
                break
            size = self.sizes[at]
            used += size * min(self.counts[at], (room - used) // size)
        return used


def packed(sizes: Sequence[int], lengths: Sequence[int], overhead: int, largest: int | None = None) -> list[tuple[int, list[int]]]:
    """Best fit decreasing. A new sequence opens at the length that costs least for each token it will hold, judged by filling it from the sizes left and
    downsizing it; with `largest` at that length, or longer if the size needs it."""
    left = Left(sizes)
    open_bins: list[tuple[int, int]] = []   # (room, bin), sorted
    contents: list[list[int]] = []
    used: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        left.take(size)
        at = bisect_left(open_bins, (size, -1))
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            wide = [c for c in lengths if c >= size]
            if largest is None:
                fills = [(size + left.fill(c - size), c) for c in wide]
                room = min(((lengths[bisect_left(lengths, f)] + overhead) / f, -c) for f, c in fills)[1] * -1
            else:
                room = max(wide[0], largest)
            b = len(contents)
            contents.append([])
            used.append(0)
        contents[b].append(i)
        used[b] += size
        if room > size:
            insort(open_bins, (room - size, b))
    return [(lengths[bisect_left(lengths, u)], c) for u, c in zip(used, contents, strict=True)]


def cost_of(bins: Sequence[tuple[int, list[int]]], overhead: int = OVERHEAD) -> int:
    return sum(c + overhead for c, _ in bins)


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD) -> list[tuple[int, list[int]]]:
    """(permitted length, items in order) of every bin; `sizes` must not exceed the largest length.

    Of the packings with the length chosen bin by bin and with each fixed opening length, the one of the least total cost is taken, the former if equal."""
    lengths = sorted(lengths)
    tried = [packed(sizes, lengths, overhead, largest) for largest in (None, *reversed(lengths))]
    return min(tried, key=lambda bins: cost_of(bins, overhead))


def best_fit(items: DataFrame, key: str = "doc_id", size: str = "n_tokens", lengths: Sequence[int] = LENGTHS,
             shard_items: int = SHARD_ITEMS, overhead: int = OVERHEAD) -> DataFrame:
    """One row per piece: its bin (shard, bin), the bin's final capacity and fill, and its place in the bin."""
    largest = max(lengths)
    rows = cut_lineage(items.select(F.col(key).cast("bigint").alias("doc_id"), F.col(size).cast("bigint").alias("n")).where("n > 0"))
    pieces = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / largest).cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece").cast("bigint") * largest).alias("piece_start"),
                           F.least(F.col("n") - F.col("piece").cast("bigint") * largest, F.lit(largest)).cast("int").alias("size"))
    total = pieces.count()
    shards = max(1, -(-total // shard_items))
    # rand() would deal a repeated task differently; the key, the piece and the size do not change
    keyed = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "size"), F.lit(shards)).cast("int"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece", "size"], na_position="first").reset_index(drop=True)
        bins = pack(group["size"].tolist(), lengths, overhead)
        order = np.concatenate([np.array(c) for _, c in bins])
        counts = [len(c) for _, c in bins]
        fill = np.add.reduceat(group["size"].to_numpy()[order], np.cumsum([0, *counts[:-1]]))
        return group.loc[order].assign(bin=np.repeat(np.arange(len(bins)), counts), capacity=np.repeat([c for c, _ in bins], counts),
                                       used=np.repeat(fill, counts), place=np.concatenate([np.arange(n) for n in counts]),
                                       )[[c.split()[0] for c in SCHEMA.split(", ")]]

    return keyed.groupBy("shard").applyInPandas(run, SCHEMA)


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents by token count, with their bins."""
    return best_fit(token_counts(read(spark, sf_dir, "documents")))
