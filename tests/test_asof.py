"""The as-of look-up of several times in one pass, against a plain search."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.operators.asof import Probe, asof_many
from tidemark.operators.costs import outcome_prices
from tidemark.sources import testtables as tt

T0 = datetime(2024, 1, 1)


def tables(seed):
    r = random.Random(seed)
    at = lambda: T0 + timedelta(seconds=r.choice([r.randrange(60), r.randrange(4000), 777]))
    left = [(r.randrange(20), r.choice("xyz"), r.choice([None, at(), at()]), at()) for _ in range(60)]
    left += left[:5]   # equal rows stay as many
    right = [(r.choice("xy"), None if r.random() < 0.05 else at(), i % 7, i) for i in range(150)]
    return left, right


def found(right, key, t, strict, forward):
    if t is None:
        return None
    rows = [x for x in right if x[0] == key and x[1] is not None
            and ((x[1] > t if strict else x[1] >= t) if forward else (x[1] < t if strict else x[1] <= t))]
    if not rows:
        return None
    end = (min if forward else max)(x[1] for x in rows)
    return (min if forward else max)((x for x in rows if x[1] == end), key=lambda x: (x[2], x[3]))[3]


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("hot_rows,broadcast_rows", [(200_000, 200_000), (3, 200_000), (3, 0), (200_000, 0)])
def test_probes_equal_plain_search(spark, forward, hot_rows, broadcast_rows):
    left, right = tables(hot_rows + broadcast_rows + forward)
    l = spark.createDataFrame(left, "n int, k string, t timestamp, u timestamp")
    r = spark.createDataFrame(right, "k string, at timestamp, tie int, v int")
    got = asof_many(l, r, ["k"], {"a": Probe("t"), "b": Probe("u", strict=True), "c": Probe("u")}, "at", ["v"], tie=["tie", "v"], bucket_s=100,
                    forward=forward, hot_rows=hot_rows, broadcast_rows=broadcast_rows)
    got = sorted((str((x.n, x.k, x.t, x.u)), *(x[c] and x[c].v for c in "abc")) for x in got.collect())
    want = sorted((str(x), found(right, x[1], x[2], False, forward), found(right, x[1], x[3], True, forward), found(right, x[1], x[3], False, forward)) for x in left)
    assert str(got) == str(want)


def test_nothing_on_either_side(spark):
    l = spark.createDataFrame([("x", T0)], "k string, t timestamp")
    r = spark.createDataFrame([("x", T0, 1)], "k string, at timestamp, v int")
    probes = {"a": Probe("t")}
    assert asof_many(l.limit(0), r, ["k"], probes, "at", ["v"]).collect() == []
    assert [x.a for x in asof_many(l, r.limit(0), ["k"], probes, "at", ["v"]).collect()] == [None]


def test_trades_cross_the_network_once_and_in_part(spark):
    trades = tt.trades(spark, SF)
    plan = outcome_prices(tt.decisions(spark, SF), trades)._jdf.queryExecution().executedPlan().toString()
    shared = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "_share" in x]
    assert len(shared) == 1, plan
    assert plan.count("trade_id") and "BroadcastHashJoin" in plan   # buckets nobody asks for are left out before the exchange


def test_a_hot_bucket_is_dealt_over_tasks(spark):
    """All right rows in one market and minute: no share holds more than a few times the limit."""
    r = spark.range(20_000).select(F.lit("x").alias("k"), (F.lit(T0) + F.make_dt_interval(secs=F.col("id") % 50)).alias("at"), F.col("id").alias("v"))
    l = spark.createDataFrame([("x", T0 + timedelta(seconds=s)) for s in (0, 10, 49, 55)], "k string, t timestamp")
    d = asof_many(l, r, ["k"], {"a": Probe("t")}, "at", ["v"], tie=["v"], hot_rows=1000)
    assert sorted((x.t, x.a.v) for x in d.collect()) == [(T0 + timedelta(seconds=s), max(i for i in range(19_000, 20_000) if i % 50 == min(s, 49))) for s in (0, 10, 49, 55)]
    shares = r.groupBy(F.pmod(F.xxhash64(F.unix_micros("at"), F.struct(F.lit(0).alias("z"), "v"), F.struct("v")), F.lit(20))).count().agg(F.max("count")).first()[0]
    assert shares < 1400
