"""Verified similarity links inside the buckets of a banding, complete without making the pairs of a bucket.

(1) Every member is compared with the smallest member of its bucket, the head. (2) Where a bucket of three or more then still lies in several
components, its members are compared with each other: buckets that share members form clusters, a cluster is cut by a hash into blocks of about
BLOCK_SHINGLES shingles or BLOCK_NODES members, and one task counts the shared shingles of one pair of blocks through an inverted index. It sends only
links that join components, so no more rows leave it than nodes enter. No bucket is capped, and no similar pair of a
bucket is missed: it ends in one component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.session import cut_lineage

BLOCK_SHINGLES = 1_000_000
BLOCK_NODES = 2_000


def similar(shared: Column, a: Column, b: Column, percent: int) -> Column:
    """`percent` of the union or more is shared, in whole numbers."""
    return 100 * shared >= percent * (a + b - shared)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets (node, shingles) are similar; sets whose sizes rule it out are not compared."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    m, n = F.size("x").cast("bigint"), F.size("y").cast("bigint")
    met = pairs.join(left, "a").join(right, "b").where(similar(F.least(m, n), m, n, percent))
    return met.where(similar(F.size(F.array_intersect("x", "y")).cast("bigint"), m, n, percent)).select("a", "b")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], at_once: int = 1 << 20) -> np.ndarray:
    """(len(left), len(right)) numbers of shared elements of sets, by an inverted index over the elements of both sides."""
    out = np.zeros(len(left) * len(right), dtype=np.int64)
    token = [np.concatenate(s) if s else np.empty(0, np.int64) for s in (left, right)]
    owner = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)]
    order = [np.argsort(t, kind="stable") for t in token]
    token = [t[o] for t, o in zip(token, order, strict=True)]
    owner = [w[o] for w, o in zip(owner, order, strict=True)]
    keys = np.intersect1d(token[0], token[1])
    begin = [np.searchsorted(t, keys) for t in token]
    count = [np.searchsorted(t, keys, side="right") - b for t, b in zip(token, begin, strict=True)]
    if len(keys):
        # one row for each place of a key on the left, wide as the key's list on the right; a long list stays within memory
        rows = np.repeat(np.arange(len(keys)), count[0])
        place = begin[0][rows] + np.arange(len(rows)) - np.repeat(np.cumsum(count[0]) - count[0], count[0])
        width = count[1][rows]
        ends = np.cumsum(width)
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - width[at] + at_once, side="right")))
            w = width[at:to]
            inner = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
            pair = np.repeat(owner[0][place[at:to]] * len(right), w) + owner[1][np.repeat(begin[1][rows[at:to]], w) + inner]
            out += np.bincount(pair, minlength=len(out))
            at = to
    return out.reshape(len(left), len(right))


def joining(left: tuple, right: tuple, percent: int) -> Iterator[tuple[int, int]]:
    """Links of similar nodes that join components not yet joined; a side is (nodes, parts, sets)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    m, n = (np.array([len(s) for s in side[2]], dtype=np.int64) for side in (left, right))
    own, other = (np.array(side[1], dtype=np.int64) for side in (left, right))
    step = max(1, (1 << 21) // max(1, len(n)))
    for at in range(0, len(m), step):
        shared = shared_counts(left[2][at:at + step], right[2])
        similar_ = 100 * shared >= percent * (m[at:at + step, None] + n[None, :] - shared)
        similar_ &= own[at:at + step, None] != other[None, :]
        for i, j in zip(*np.nonzero(similar_), strict=True):
            p, q = find(left[1][at + i]), find(right[1][j])
            if p != q:
                parent[max(p, q)] = min(p, q)
                yield int(left[0][at + i]), int(right[0][j])


def inside_clusters(sets: DataFrame, percent: int, block: int = BLOCK_SHINGLES, nodes: int = BLOCK_NODES) -> DataFrame:
    """Links (a, b) of a checkpointed frame (cluster, node, part, shingles), read several times.

    Clusters of one block are dealt into bins of about a block, so that a task is not called for each of many small clusters."""
    size = F.sum(F.size("shingles").cast("bigint"))
    blocks = sets.groupBy("cluster").agg(F.greatest(F.ceil(size / block), F.ceil(F.count("*") / nodes), F.lit(1)).cast("int").alias("blocks"))
    rows = cut_lineage(sets.join(blocks, "cluster"))
    total = rows.where("blocks = 1").agg(F.count("*").alias("n"), F.coalesce(size, F.lit(0)).alias("s")).first()
    bins = max(1, -(-total["n"] // nodes), -(-total["s"] // block))
    small = rows.where("blocks = 1").select(F.pmod(F.xxhash64("cluster"), F.lit(bins)).alias("cluster"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"),
                                            F.lit(-1).alias("mine"), "node", "part", "shingles")
    large = rows.where("blocks > 1").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    large = large.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    large = large.select("cluster", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "node", "part", "shingles")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sides = [(g["node"].tolist(), g["part"].tolist(), g["shingles"].tolist())
                 for g in (group[group["mine"] == group["lo"].iloc[0]], group[group["mine"] == group["hi"].iloc[0]])]
        return pd.DataFrame(list(joining(*sides, percent)), columns=["a", "b"], dtype="int64")

    return small.unionByName(large).groupBy("cluster", "lo", "hi").applyInPandas(run, "a bigint, b bigint")


def grouped(crowded: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(node, component) of all nodes with a verified link; component is the smallest node reachable. `crowded`: (bucket, node, head) of all buckets
    with several nodes, read several times; `sets_of(nodes)`: one row (node, shingles) for every node of a frame (node).

    Links found inside clusters join components that are known by then, so only these few components are united once more."""
    pairs = cut_lineage(crowded.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct())
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = cut_lineage(sets_of(nodes))
    known = cut_lineage(components(verified(pairs, sets, percent)))
    named = crowded.join(known, "node", "left").select("bucket", "node", "head", F.coalesce("component", "node").alias("part"))
    spread = named.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n"))
    mixed = named.join(spread.where("low <> high and n > 2").select("bucket"), "bucket")
    mixed = cut_lineage(mixed.select("node", "head", "part").distinct())
    if mixed.isEmpty():
        return known
    cluster = components(mixed.select(F.col("head").alias("a"), F.col("node").alias("b")).where("a <> b"))
    of = cut_lineage(mixed.select("node", "part").distinct().join(cluster, "node").withColumnRenamed("component", "cluster"))
    more = cut_lineage(inside_clusters(cut_lineage(sets.join(of, "node")), percent))
    if more.isEmpty():
        return known
    part = of.select("node", "part").distinct()
    parts = (more.join(part.select(F.col("node").alias("a"), F.col("part").alias("p")), "a")
             .join(part.select(F.col("node").alias("b"), F.col("part").alias("q")), "b").select(F.col("p").alias("a"), F.col("q").alias("b")))
    united = components(parts).select(F.col("node").alias("part"), F.col("component").alias("whole"))
    every = known.withColumnRenamed("component", "part").unionByName(united.select(F.col("part").alias("node"), "part")).distinct()
    # a part that is no component of `known` is a node of its own; one that is stands there with itself
    return every.join(united, "part", "left").select("node", F.coalesce("whole", "part").alias("component"))
