"""Operator 3: exact top-k inner-product search with a vector-approximation file.

Vectors are dealt into blocks by a hash of their id. A block keeps per dimension up to `cells` cells,
narrower where vectors are many, the cell number of every component, and the exact vectors. A search scans the
cells for an upper bound of every score (the lower bound of the distance, which is the negative score), one matrix product for
a chunk of queries. In the first block that a query meets it reads the exact vectors of the highest bounds; from then on, and in all
blocks that follow, only those whose bound reaches the k-th best score so far. Each pair of a query block and a group of vector blocks
is one task with bounded memory, so tasks are small and can be run again; only k rows per query and group leave it. The query set is stated (ids divisible by
`query_every`) and meets all rows in blocks.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do null
ids. Repeated rows are candidates of their own, so an id can come up more than once; an id asks once, with its smallest array, and no row of
its own id is a candidate of it. Only vectors of the same length are compared. Ties go to the smaller id. Components are long integers: where floor(scale · x) lies beyond
a long it counts as the nearest long, and so does a score. Scores are exact: products that may pass 2^62 are computed with Python integers. With
fewer than k candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import mul
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import read

BLOCK_ROWS = 4096
CELLS = 16
ASKED_ROWS = 32_768   #: queries of a block
GROUP_BLOCKS, GROUPS = 16, 48   #: vector blocks that a task reads at most, and tasks that a query block is dealt to where there are so many vector blocks
_LONG = (1 << 63) - 1
_NONE = -(1 << 63)   #: stands for no score; scores are -_LONG at least
_PAIRS = 1 << 14   #: exact vectors read at once
_CHUNK = 256   #: queries whose bounds are held at once


def quantised(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale · x) of every usable vector."""
    x = F.col("x")
    usable = (F.col("id").isNotNull() & (F.size(x) > 0)
              & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    whole = F.transform(x, lambda c: F.floor(c * scale))
    rows = embeddings.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    return rows.where(usable).select(F.col("id").alias("vec_id"), whole.alias("v"))


def cells_of(exact: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers (n, d) and the lowest and highest component of every cell (cells, d). Cells begin half-way between those of equally many vectors, whose
    outer ones are wide, and those of equal width."""
    n, d = exact.shape
    codes = np.zeros((n, d), dtype=np.uint8)
    low, high = np.zeros((cells, d)), np.zeros((cells, d))
    low_most, high_most = exact.min(axis=0).astype(float), exact.max(axis=0).astype(float)
    for j in range(d):
        parts = np.linspace(0, 1, cells + 1)[1:-1]
        edges = (np.quantile(exact[:, j], parts) + low_most[j] + parts * (high_most[j] - low_most[j])) / 2
        codes[:, j] = np.searchsorted(edges, exact[:, j], side="right")
        for c in range(cells):
            inside = exact[codes[:, j] == c, j]
            if len(inside):
                low[c, j], high[c, j] = inside.min(), inside.max()
    return codes, low, high


def narrow(whole: np.ndarray) -> bytes:
    """Integers in the fewest bytes that hold all of them: 2, 4 or 8 each."""
    most = max(abs(int(whole.max(initial=0))), abs(int(whole.min(initial=0))))
    return whole.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def wide(raw: bytes, n: int, d: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{len(raw) // (n * d)}").reshape(n, d)


def _pack(rows: DataFrame, blocks: int, name: str, cells: int = 0) -> DataFrame:
    """One row per (dim, block): ids, exact vectors and, with `cells`, the approximation. Rows are told apart by vec_id, v and copy."""
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        exact = np.stack(group["v"].tolist()).astype("<i8")
        codes, low, high = cells_of(exact, cells) if cells else (exact[:0].astype(np.uint8), exact[:0], exact[:0])
        return pd.DataFrame({"dim": [exact.shape[1]], name: [group["b"].iloc[0]], "ids": [group["vec_id"].to_numpy("<i8").tobytes()],
                             "exact": [narrow(exact)], "codes": [codes.tobytes()],
                             "edges": [np.stack([low, high]).astype("<f8").tobytes()]})

    keyed = rows.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", "v", "copy"), F.lit(blocks)).cast("int").alias("b"))
    return keyed.groupBy("dim", "b").applyInPandas(
        pack, f"dim int, {name} int, ids binary, exact binary, codes binary, edges binary")


def exact_in(most: int) -> type:
    """Numbers in which sums of products up to `most` are exact; Python's beyond all others."""
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object


def paired(exact: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products row by row, of numbers as `exact_in` says; those beyond a long count as the nearest one."""
    if exact.dtype != object:
        return np.einsum("ij,ij->i", exact, query).astype(np.int64)
    return np.array([max(-_LONG, min(_LONG, sum(map(mul, v, q)))) for v, q in zip(exact.tolist(), query.tolist(), strict=True)], dtype=np.int64)


class Block(NamedTuple):
    """Vectors with the centre and half the width of the cell of every component, side by side."""

    ids: np.ndarray
    exact: np.ndarray
    cells: np.ndarray
    norm: float       #: no |centre| + half width is longer
    largest: int      #: no component is larger

    @classmethod
    def of(cls, exact: np.ndarray, ids: np.ndarray, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> Block:
        dims = np.arange(exact.shape[1])
        middle, half = (low + high) / 2, (high - low) / 2
        norm = float(np.sqrt(((np.abs(middle) + half).max(axis=0) ** 2).sum()))
        return cls(ids, exact, np.concatenate([middle[codes, dims], half[codes, dims]], axis=1), norm, max(map(abs, (int(exact.max()), int(exact.min())))))


class Best:
    """The k best (score, id) of each query so far, best first; _NONE where there are fewer."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, k: int):
        self.queries, self.query_ids, self.k = queries, query_ids, k
        self.scores, self.ids = np.full((len(queries), k), _NONE, dtype=np.int64), np.zeros((len(queries), k), dtype=np.int64)
        self.read = np.zeros(len(queries), dtype=np.int64)   #: exact vectors read
        self.largest = max(map(abs, (int(queries.max(initial=0)), int(queries.min(initial=0)))))

    def meet(self, block: Block) -> None:
        small = max(self.largest, block.largest) < 1 << 24   # whole and half numbers of single precision
        cells = block.cells.astype(np.float32 if small else np.float64)
        exact = block.exact.astype(exact_in(self.largest * block.largest * block.exact.shape[1]))
        order = np.argsort(block.ids, kind="stable")
        own_from, own_to = (np.searchsorted(block.ids, self.query_ids, side, sorter=order) for side in ("left", "right"))
        for at in range(0, len(self.queries), _CHUNK):
            rows = np.arange(at, min(at + _CHUNK, len(self.queries)))
            part = self.queries[rows].astype(cells.dtype)
            upper = np.concatenate([part, np.abs(part)], axis=1) @ cells.T
            # sums are rounded by no more than this share of their absolute terms, scores as numbers of this precision by one eps
            slack = (2 * part.shape[1] + 16) * float(np.finfo(cells.dtype).eps) * np.sqrt((part.astype(np.float64) ** 2).sum(axis=1)) * block.norm
            count = own_to[rows] - own_from[rows]
            place = np.repeat(own_from[rows], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            upper[np.repeat(rows - at, count), order[place]] = -np.inf
            new = np.flatnonzero(self.scores[rows, -1] == _NONE)
            some = min(len(block.ids), 8 * self.k)
            if len(new):
                top = np.argpartition(upper[new], len(block.ids) - some, axis=1)[:, len(block.ids) - some:]
                pairs = np.repeat(new, some), top.reshape(-1)
                seen = upper[pairs] > -np.inf
                self.take(at, pairs[0][seen], pairs[1][seen], exact, block)
                upper[pairs] = -np.inf
            worst = self.scores[rows, -1].astype(np.float64)
            least = worst - slack - np.abs(worst) * 4 * float(np.finfo(cells.dtype).eps)
            least = np.where(self.scores[rows, -1] == _NONE, np.finfo(cells.dtype).min, least).astype(cells.dtype)
            if not small:   # beyond a long, scores count as the nearest one
                reached = upper > -np.inf
                np.clip(upper, -2.0 ** 63, 2.0 ** 63, out=upper)
                upper[~reached] = -np.inf
            reached = np.flatnonzero(upper >= least[:, None])
            self.take(at, reached // len(block.ids), reached % len(block.ids), exact, block)

    def take(self, at: int, row: np.ndarray, place: np.ndarray, exact: np.ndarray, block: Block) -> None:
        """Read these exact vectors for the queries at + row, and keep the best."""
        n = min(_CHUNK, len(self.queries) - at)
        part = self.queries[at:at + n].astype(exact.dtype)
        self.read[at:at + n] += np.bincount(row, minlength=n)
        for lo in range(0, len(row), _PAIRS):
            r, p = row[lo:lo + _PAIRS], place[lo:lo + _PAIRS]
            found = paired(exact[p], part[r])
            good = found >= self.scores[at + r, -1]
            r, p, found = r[good], p[good], found[good]
            every = np.concatenate([np.repeat(np.arange(n), self.k), r])
            score, ids = np.concatenate([self.scores[at:at + n].reshape(-1), found]), np.concatenate([self.ids[at:at + n].reshape(-1), block.ids[p]])
            order = np.lexsort((ids, ~score, every))
            first = np.searchsorted(every[order], np.arange(n))
            kept = order[first[:, None] + np.arange(self.k)]
            self.scores[at:at + n], self.ids[at:at + n] = score[kept], ids[kept]


def search_block(queries: np.ndarray, query_ids: np.ndarray, exact: np.ndarray, ids: np.ndarray, codes: np.ndarray,
                 low: np.ndarray, high: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query id, ids, scores, exact vectors read) of the k best vectors of one block for each query."""
    best = Best(queries, query_ids, k)
    best.meet(Block.of(exact, ids, codes, low, high))
    for i, found in enumerate(best.scores != _NONE):
        yield int(query_ids[i]), best.ids[i, found], best.scores[i, found], int(best.read[i])


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, block_rows: int = BLOCK_ROWS, cells: int = CELLS, asked_rows: int = ASKED_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the quantised vectors (vec_id, v)."""
    asks = F.col("vec_id") % query_every == 0
    total, queries = vectors.agg(F.count("*"), F.count_if(asks)).first()
    blocks, askers = max(1, -(-total // block_rows)), max(1, -(-queries // asked_rows))
    groups = min(blocks, max(GROUPS, -(-blocks // GROUP_BLOCKS)))
    # of equal rows no more than k can be among the k best, so a mass of copies is no group
    counted = vectors.groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    data = _pack(counted.select("vec_id", "v", F.explode(F.sequence(F.lit(1), "n")).alias("copy")), blocks, "block", cells)
    asking = vectors.where(asks).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = _pack(asking.withColumn("copy", F.lit(1)), askers, "asked")
    met = ["dim", "asked", "group"]
    data = data.select("dim", F.explode(F.sequence(F.lit(0), F.lit(askers - 1))).alias("asked"), F.pmod("block", F.lit(groups)).alias("group"), "ids", "exact", "codes", "edges")
    asked = asked.select("dim", "asked", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "ids", "exact")
    tasks = min(4000, 2 * askers * groups)   # the work is not in proportion to the bytes, so partitions are not to be joined by size
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(asked: pa.Table, data: pa.Table) -> pa.Table:
        if not len(asked) or not len(data):
            return schema.empty_table()
        d, ids = asked["dim"][0].as_py(), np.frombuffer(asked["ids"][0].as_py(), "<i8")
        best = Best(wide(asked["exact"][0].as_py(), len(ids), d), ids, k)
        for r in range(len(data)):
            ids, exact, codes, edges = (data[c][r].as_py() for c in ("ids", "exact", "codes", "edges"))
            ids = np.frombuffer(ids, "<i8")
            low, high = np.frombuffer(edges, "<f8").reshape(2, cells, d)
            best.meet(Block.of(wide(exact, len(ids), d), ids, np.frombuffer(codes, np.uint8).reshape(-1, d), low, high))
        row, at = np.nonzero(best.scores != _NONE)
        return pa.table([best.query_ids[row], best.ids[row, at], best.scores[row, at]], schema=schema)

    found = (asked.repartition(tasks, *met).groupBy(*met).cogroup(data.repartition(tasks, *met).groupBy(*met))
             .applyInArrow(run, "query_id bigint, vec_id bigint, score bigint"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op3_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every query vector."""
    return top_k(quantised(read(spark, sf_dir, "embeddings")))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
q AS (SELECT vec_id, min(e) AS e FROM v GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
