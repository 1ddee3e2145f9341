"""As-of joins over bucketed time.

Both sides are merged into one stream per (key, time bucket); the value wanted is the last one
seen. What a bucket needs from earlier buckets enters as one extra row at its start. No range
join, no window over a whole key, and one shuffle of either side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sequence import _keyed
from tidemark.session import cut_lineage


def _time(ts: str, forward: bool) -> Column:
    t = F.unix_micros(F.col(ts))
    return -t if forward else t


def asof(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str,
         payload: list[str], tie: list[str] | None = None, bucket_s: int = 86400,
         forward: bool = False, strict: bool = False, probe: DataFrame | None = None) -> DataFrame:
    """For every left row the nearest right row of the same key at or before its time.

    forward=True looks for the first right row at or after it. strict=True excludes equal times.
    `tie` orders right rows of equal time; the last one wins (the first one when forward).
    Left rows without a match keep NULLs. Payload names must differ from the left columns.
    `probe` may name a cheaper frame with the keys and times of the left side (for example the
    input of an earlier as-of join); it tells which buckets are asked for.
    """
    tie = tie or []
    width = int(bucket_s) * 1000000
    bucket = F.floor(F.col("_t") / F.lit(width)).cast("bigint")
    at_left, at_right = (0, 1) if strict else (1, 0)
    tie_struct = F.struct(F.lit(0).alias("z"), *[F.col(c) for c in tie])
    tie_type = right.select(tie_struct.alias("k")).schema["k"].dataType
    val = F.struct(*payload)
    val_type = right.select(val.alias("v")).schema["v"].dataType
    lrow = F.struct(*left.columns)
    lrow_type = left.select(lrow.alias("l")).schema["l"].dataType

    r = (right.where(F.col(right_ts).isNotNull())
         .select(*by, _time(right_ts, forward).alias("_t"), F.lit(at_right).alias("_k"),
                 tie_struct.alias("_tie"), val.alias("_v"))
         .withColumn("_b", bucket))
    if forward and tie:
        # the scan runs backwards in time, so reverse the tie order as well
        r = r.groupBy(*by, "_b", "_t", "_k").agg(
            F.min("_tie").alias("_tie"), F.min_by("_v", "_tie").alias("_v"))
    l = (left.select(*by, _time(left_ts, forward).alias("_t"), F.lit(at_left).alias("_k"),
                     F.lit(None).cast(tie_type).alias("_tie"), F.lit(None).cast(val_type).alias("_v"),
                     lrow.alias("_l"))
         .withColumn("_b", bucket))

    totals = r.groupBy(*by, "_b").agg(
        F.max_by("_v", F.struct("_t", "_tie")).alias("_v"), F.lit(0).alias("_q"))
    keys = l if probe is None else probe.select(
        *by, _time(left_ts, forward).alias("_t")).withColumn("_b", bucket)
    asked = keys.groupBy(*by, "_b").agg(F.lit(None).cast(val_type).alias("_v"), F.lit(1).alias("_q"))
    summary = (totals.unionByName(asked).groupBy(*by, "_b")
               .agg(F.first("_v", ignorenulls=True).alias("_v"), F.max("_q").alias("_q")))
    w = (Window.partitionBy(*_keyed(by)).orderBy("_b")
         .rowsBetween(Window.unboundedPreceding, -1))
    seeds = (summary.withColumn("_v", F.last("_v", ignorenulls=True).over(w))
             .where((F.col("_q") == 1) & F.col("_v").isNotNull())
             .select(*by, (F.col("_b") * width).alias("_t"), F.lit(-1).alias("_k"),
                     F.lit(None).cast(tie_type).alias("_tie"), "_v",
                     F.lit(None).cast(lrow_type).alias("_l"), "_b"))

    merged = (r.withColumn("_l", F.lit(None).cast(lrow_type))
              .unionByName(l).unionByName(seeds))
    seen = (Window.partitionBy(*_keyed(by), "_b").orderBy("_t", "_k", "_tie")
            .rowsBetween(Window.unboundedPreceding, 0))
    return (merged.withColumn("_v", F.last("_v", ignorenulls=True).over(seen))
            .where(F.col("_l").isNotNull())
            .select("_l.*", *[F.col(f"_v.{c}").alias(c) for c in payload]))


HOT_ROWS = 200_000       #: right rows of one (key, bucket) that a task takes; fuller buckets are dealt over several tasks
BROADCAST_ROWS = 200_000   #: asked buckets (a key and three numbers each) that may be broadcast


@dataclass(frozen=True)
class Probe:
    """A time column of the left side; strict excludes right rows of equal time."""

    at: str
    strict: bool = False


def asof_many(left: DataFrame, right: DataFrame, by: list[str], probes: dict[str, Probe], right_ts: str, payload: list[str], tie: list[str] | None = None,
              bucket_s: int = 60, forward: bool = False, hot_rows: int = HOT_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Several as-of look-ups of the same right side in one pass: left columns and a struct of the payload per probe (NULL without a match).

    The right side is first summed up per (key, bucket): its last row and its count. Only buckets that some probe falls into send their rows; what lies before comes
    from the summary. So the right side crosses the network once, and only in part. A bucket of more than `hot_rows` rows is dealt over tasks
    by a hash; its probes visit every share and keep the nearest row. Rows of equal time: the last one by `tie`, the first one when forward.
    """
    tie, width = tie or [], int(bucket_s) * 1000000
    bucket = F.floor(F.col("_t") / F.lit(width)).cast("bigint")
    r = right.where(F.col(right_ts).isNotNull()).select(
        *by, _time(right_ts, forward).alias("_t"), F.struct(F.lit(0).alias("z"), *tie).alias("_tie"), F.struct(*payload).alias("_v")).withColumn("_b", bucket)
    names = list(probes)
    asks = F.array(*[F.struct(F.lit(n).alias("_name"), _time(p.at, forward).alias("_t"), F.lit(0 if p.strict else 2).alias("_k")) for n, p in probes.items()])
    p = left.select(*by, F.struct(*left.columns).alias("_l"), F.explode(asks).alias("_x")).select(*by, "_l", "_x.*").withColumn("_b", bucket)

    def nearest(value: str, t: str, order: str) -> Column:
        return F.min_by(value, F.struct(-F.col(t), order)) if forward else F.max_by(value, F.struct(t, order))

    totals = r.groupBy(*by, "_b").agg(nearest("_v", "_t", "_tie").alias("_v"), F.count(F.lit(1)).alias("_rows"))
    asked = p.where(F.col("_b").isNotNull()).select(*by, "_b").distinct().withColumn("_asked", F.lit(True))
    both = totals.unionByName(asked, allowMissingColumns=True).groupBy(*by, "_b").agg(
        F.first("_v", ignorenulls=True).alias("_v"), F.max("_rows").alias("_rows"), F.max("_asked").alias("_asked"))
    before = Window.partitionBy(*_keyed(by)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    need = cut_lineage(both.withColumn("_seed", F.last("_v", ignorenulls=True).over(before)).where("_asked").select(
        *by, "_b", "_seed", F.ceil(F.greatest(F.lit(1), F.coalesce("_rows", F.lit(1))) / hot_rows).cast("int").alias("_shares")))
    size = need.agg(F.count(F.lit(1)).alias("n"), F.max("_shares").alias("m")).first()
    small = size["n"] <= broadcast_rows
    wanted = need.select(*by, "_b", "_shares")
    rr = r.join(F.broadcast(wanted) if small else wanted, [*by, "_b"])
    rr = rr.withColumn("_share", F.pmod(F.xxhash64("_t", "_tie", "_v"), F.col("_shares")).cast("int"))
    if not small and size["m"] > 1:
        rr = rr.repartition(*by, "_b", "_share")
    rr = rr.select(*by, "_b", "_share", "_t", F.lit(1).alias("_k"), "_tie", F.struct("_t", "_tie", "_v").alias("_w"))
    pp = p.join(need, [*by, "_b"], "left").withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1)))
    pp = pp.select(*by, "_b", "_share", "_t", "_k", "_l", "_name", "_seed")
    order = F.col("_tie").desc() if forward else F.col("_tie").asc()   # the scan runs backwards in time when forward
    seen = Window.partitionBy(*_keyed(by), "_b", "_share").orderBy("_t", "_k", order).rowsBetween(Window.unboundedPreceding, 0)
    met = rr.unionByName(pp, allowMissingColumns=True).withColumn("_w", F.last("_w", ignorenulls=True).over(seen)).where(F.col("_name").isNotNull())

    def answer(name: str) -> Column:
        mine = met["_name"] == name
        own = F.struct(F.when(mine, F.col("_w._t")).alias("t"), F.when(mine, F.col("_w._tie")).alias("tie"))
        value = F.when(mine, F.col("_w._v"))
        ranked = F.when(mine & F.col("_w").isNotNull(), F.struct(-own["t"], own["tie"]) if forward else own)
        best = F.min_by(value, ranked) if forward else F.max_by(value, ranked)
        return F.coalesce(best, F.first(F.when(mine, F.col("_seed")), ignorenulls=True)).alias(f"_r_{name}")

    once = F.sum(F.when((F.col("_name") == names[0]) & (F.col("_share") == 0), 1).otherwise(0)).cast("int").alias("_times")
    out = met.groupBy("_l").agg(once, *[answer(n) for n in names])
    out = out.withColumn("_i", F.explode(F.array_repeat(F.lit(0), F.col("_times"))))   # equal left rows come back as often as they came
    return out.select("_l.*", *[F.col(f"_r_{n}").alias(n) for n in names])
