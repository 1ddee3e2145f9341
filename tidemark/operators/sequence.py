"""Ordered work on few, very large keys.

A window over a whole key would put a third of the data into one task. Everything here cuts a
key into buckets, works inside (key, bucket) and passes a small per-bucket summary along the key.
The summary has one row per (key, bucket), so its window is bounded by the time span.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keyed(by: list[str]) -> list[Column]:
    return [F.col(c) for c in by] if by else [F.lit(0)]


@dataclass(frozen=True)
class Carry:
    """What a bucket hands on: an aggregate per bucket and how earlier buckets combine."""

    agg: Column
    combine: Callable[[Column], Column]


def last_value(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


def with_carry(df: DataFrame, by: list[str], bucket: str, carries: dict[str, Carry],
               backward: bool = False) -> DataFrame:
    """Add, per row, the combined aggregate over all earlier (or later) buckets of its key."""
    summary = df.groupBy(*by, bucket).agg(*[c.agg.alias(f"_a_{n}") for n, c in carries.items()])
    order = F.col(bucket).desc() if backward else F.col(bucket).asc()
    w = (Window.partitionBy(*_keyed(by)).orderBy(order)
         .rowsBetween(Window.unboundedPreceding, -1))
    summary = summary.select(
        *by, bucket, *[c.combine(F.col(f"_a_{n}")).over(w).alias(n) for n, c in carries.items()])
    return df.join(summary, [*by, bucket], "left")


def with_row_index(df: DataFrame, by: list[str], order: list[Column], bucket: Column,
                   name: str = "idx") -> DataFrame:
    """1-based position inside each key without a window over the whole key.

    `bucket` must rise with the order, e.g. a day number of the leading time column.
    """
    d = df.withColumn("_b", bucket)
    d = with_carry(d, by, "_b", {"_before": Carry(F.count(F.lit(1)), F.sum)})
    w = Window.partitionBy(*by, "_b").orderBy(*order)
    return (d.withColumn(name, F.coalesce("_before", F.lit(0)) + F.row_number().over(w))
            .withColumn(name, F.col(name).cast("bigint"))
            .drop("_b", "_before"))


def with_blocks(df: DataFrame, idx: str, rows: int, halo: int) -> DataFrame:
    """Number blocks of `rows` rows; the last `halo` rows of a block also appear in the next.

    Copies carry `_own` = false and only feed windows that look back.
    """
    own = F.floor((F.col(idx) - 1) / rows).cast("bigint")
    tail = (F.col(idx) - 1) % rows >= rows - halo
    return (df.withColumn("_own_block", own)
            .withColumn("_block", F.explode(
                F.when(tail, F.array(F.col("_own_block"), F.col("_own_block") + 1))
                .otherwise(F.array("_own_block"))))
            .withColumn("_own", F.col("_block") == F.col("_own_block"))
            .drop("_own_block"))


@dataclass(frozen=True)
class Affine:
    """y_t = a·y_{t−1} + b_t with y_0 = 0."""

    name: str
    a: float
    b: Column


CARRY_BLOCKS = 8


def affine_scan(df: DataFrame, by: list[str], idx: str, rows: int, specs: list[Affine]) -> DataFrame:
    """Run several first-order recurrences over rows numbered 1.. per key in `_block`s.

    Inside a block y_i = a^i·(carry + Σ_{j≤i} a^(−j)·b_j), a running window sum. All blocks but
    the last are full, so the carry is a fold of the preceding block totals with weight a^rows.
    Eight totals are folded; the weight of what lies before them, a^(8·rows), is far below
    double precision for every decay used here (checked below).
    """
    for s in specs:
        if s.a ** (CARRY_BLOCKS * rows) > 1e-30 or s.a ** rows < 1e-250:
            raise ValueError(f"block of {rows} rows does not fit decay {s.a}")
    pos = (F.col(idx) - 1) % rows + 1
    running = (Window.partitionBy(*by, "_block").orderBy(idx)
               .rowsBetween(Window.unboundedPreceding, 0))
    d = df.select("*", *[
        F.sum(F.coalesce(s.b, F.lit(0.0)) * F.pow(F.lit(s.a), -pos)).over(running)
        .alias(f"_s_{s.name}") for s in specs])
    totals = d.groupBy(*by, "_block").agg(*[
        (F.max_by(f"_s_{s.name}", idx) * F.lit(s.a ** rows)).alias(f"_t_{s.name}") for s in specs])
    earlier = (Window.partitionBy(*_keyed(by)).orderBy("_block")
               .rowsBetween(-CARRY_BLOCKS, -1))

    def fold(s: Affine) -> Column:
        weight = F.lit(s.a ** rows)
        return F.aggregate(F.collect_list(f"_t_{s.name}").over(earlier), F.lit(0.0),
                           lambda acc, t: acc * weight + t).alias(f"_c_{s.name}")

    carries = totals.select(*by, "_block", *[fold(s) for s in specs])
    d = d.join(carries, [*by, "_block"], "left")
    return d.select(*df.columns, *[
        (F.pow(F.lit(s.a), pos) * (F.coalesce(F.col(f"_c_{s.name}"), F.lit(0.0))
                                   + F.col(f"_s_{s.name}"))).alias(s.name) for s in specs])
