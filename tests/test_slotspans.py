"""Spans of slots against plain enumeration."""

import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import news
from tidemark.operators import neardup
from tidemark.operators import slotspans as S
from tidemark.session import cut_lineage, small_side

T0 = datetime(2024, 1, 1)


def grid_of(spark, sizes):
    rows = [(k, T0 + timedelta(minutes=7 * i + i % 3)) for k, n in sizes.items() for i in range(n)]
    return S.slot_grid(spark.createDataFrame(rows, "k string, cutoff_at timestamp"), ["k"]), rows


@pytest.mark.parametrize("n", [1, 2, 5, 8, 13])
def test_blocks_cover_every_span_once(spark, n):
    levels = int(n).bit_length() + 1
    spans = spark.createDataFrame([(a, b) for a in range(n) for b in range(a, n + 3)], "a bigint, b bigint")
    got = defaultdict(list)
    for r in S.in_blocks(spans, "a", "b", levels).collect():
        got[r.a, r.b] += range(r.block << r.level, (r.block + 1) << r.level)
    for a in range(n):
        for b in range(a, n + 1):
            assert sorted(got[a, b]) == list(range(a, b))
        for b in range(n + 1, n + 3):
            assert [x for x in sorted(got[a, b]) if x < n] == list(range(a, n))


def test_totals_equal_enumeration(spark):
    r = random.Random(4)
    grid, rows = grid_of(spark, {"x": 37, "y": 1, "z": 0})
    spans = [(i, r.choice("xy"), a := r.randrange(0, 38), a + r.randrange(0, 20), r.randrange(100), T0 - timedelta(hours=r.randrange(50))) for i in range(200)]
    df = spark.createDataFrame(spans, "id bigint, k string, a bigint, b bigint, v bigint, born timestamp")
    got = {(x.k, x.cutoff_at): x for x in S.slot_totals(df, grid, ["k"], "a", "b", {"n": F.lit(1), "v": F.col("v")}, {"top": F.col("v")}, age_of="born").collect()}
    want = 0
    for k in "xy":
        for s, at in enumerate(sorted(t for kk, t in rows if kk == k)):
            live = [x for x in spans if x[1] == k and x[2] <= s < x[3]]
            if live:
                want += 1
                g = got[k, at]
                assert (g.n, g.v, g.top) == (len(live), sum(x[4] for x in live), max(x[4] for x in live))
                assert abs(g.age_sum - sum((at - x[5]).total_seconds() for x in live)) < 1e-5
    assert want == len(got)


def test_times_become_slot_numbers(spark):
    grid, rows = grid_of(spark, {"x": 20})
    slots = sorted(t for _, t in rows)
    asked = [(i, "x", T0 + timedelta(minutes=m), T0 + timedelta(minutes=m, microseconds=1)) for i, m in enumerate(range(-20, 160, 3))]
    df = spark.createDataFrame(asked, "id bigint, k string, t timestamp, u timestamp")
    got = S.at_slot_numbers(df, grid, ["k"], "id", {"first": F.col("t"), "last": F.col("u")}).collect()
    number = lambda t: next((i for i, s in enumerate(slots) if s >= t), 1 << 40)
    assert len(got) == len(asked) and all((g["first"], g["last"]) == (number(g.t), number(g.u)) for g in got)


def test_groups_of_long_chains_and_rings(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100)] + [(200, 200 + i) for i in range(1, 30)]
    both = [(f"{a:04d}", f"{b:04d}") for a, b in pairs] + [(f"{b:04d}", f"{a:04d}") for a, b in pairs]
    got = dict(map(tuple, S.groups_of(spark.createDataFrame(both, "a string, b string"), "a", "b").collect()))
    assert {m: g for m, g in got.items()} == {f"{m:04d}": f"{0 if m <= 60 else 100 if m < 200 else 200:04d}" for m in [*range(61), 100, 101, 102, *range(200, 230)]}
    assert S.groups_of(spark.createDataFrame([], "a string, b string"), "a", "b").collect() == []


def test_kept_events_equal_the_rule_at_every_slot(spark):
    """Entries, exits, revisions, copies and similar texts, judged slot by slot in plain Python."""
    r = random.Random(8)
    base = [" ".join(f"w{r.randrange(60)}" for _ in range(30)) for _ in range(4)]
    texts = base + [t + " tail" for t in base] + [t.replace("w1", "v1", 1) for t in base]
    items = []
    for i in range(90):
        seen = T0 + timedelta(minutes=r.randrange(3000))
        items.append((f"r{i:03d}", "BTC", f"s{r.randrange(45)}", f"e{r.randrange(50)}", r.randrange(3), seen + timedelta(minutes=r.randrange(30)), seen, None,
                      r.choice(["CONFIRMED", "RUMOR", None]), r.choice(texts)))
    df = spark.createDataFrame(items, "record_id string, asset string, source_key string, event_id string, revision int, available_at timestamp,"
                                      " source_observed_at timestamp, published_at timestamp, status string, title string").withColumn("body", F.col("title"))
    for c, v in (("publisher", F.lit("p")), ("language", F.lit("English")), ("sentiment", F.lit(0.1)), ("relevance", F.lit(0.5))):
        df = df.withColumn(c, v)
    slots = [("BTC", "swing_24h", T0 + timedelta(minutes=m)) for m in range(0, 4600, 95)]
    grid = S.slot_grid(spark.createDataFrame(slots, "asset string, horizon string, cutoff_at timestamp"), ["asset", "horizon"])
    classes = neardup.text_classes(df, "body")
    similar = neardup.similar_pairs(classes, places=neardup.places_of(df, classes))
    judged = news.retained_spans(grid, df, classes, similar)
    got = defaultdict(set)
    for x in S.rows_at_slots(judged, grid, ["asset", "horizon"], "first", "last", S.grid_levels(grid)).collect():
        got[x.cutoff_at].add((x.event_id, x.record_id, x.kept))
    sets = {t: {tuple(t.split()[i:i + 3]) for i in range(len(t.split()) - 2)} for t in texts}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.85
    for _, _, at in slots:
        current = {}
        for x in sorted((x for x in items if x[5] <= at), key=lambda x: (x[4], x[5], x[0])):
            current[x[2]] = x
        events = {}
        for x in sorted((x for x in current.values() if 0 <= (at - x[6]).total_seconds() <= 86400), key=lambda x: (x[5], x[0])):
            events[x[3]] = x
        kept, want = [], set()
        for e, x in sorted(events.items(), key=lambda p: (p[1][5], p[0])):
            drop = any((x[8] or "") == (y[8] or "") and alike(x[9], y[9]) and abs((x[6] - y[6]).total_seconds()) <= 48 * 3600 for y in kept)
            kept += [] if drop else [x]
            want.add((e, x[0], not drop))
        assert got[at] == want, at


@pytest.mark.parametrize("limit", [1000, 0])
def test_only_texts_that_stand_for_an_event_are_compared(spark, monkeypatch, limit):
    """Many versions of few events between two slots: the spans are those of all texts compared, the texts asked for are those that some slot sees."""
    r = random.Random(9)
    base = [[f"w{r.randrange(50)}" for _ in range(30)] for _ in range(4)]
    items = [(f"r{i:03d}", "BTC", f"s{i}", f"e{i % 12}", 0, T0 + timedelta(minutes=5 * i + 1), T0 + timedelta(minutes=5 * i), None, "RUMOR",
              " ".join(base[i % 4] + [f"x{i % 7}"])) for i in range(200)]
    df = spark.createDataFrame(items, "record_id string, asset string, source_key string, event_id string, revision int, available_at timestamp,"
                                      " source_observed_at timestamp, published_at timestamp, status string, body string")
    for c, v in (("publisher", F.lit("p")), ("language", F.lit("English")), ("sentiment", F.lit(0.1)), ("relevance", F.lit(0.5))):
        df = df.withColumn(c, v)
    slots = [("BTC", "swing_24h", T0 + timedelta(minutes=200 * k)) for k in range(7)]
    grid = S.slot_grid(spark.createDataFrame(slots, "asset string, horizon string, cutoff_at timestamp"), ["asset", "horizon"])
    asked = []

    def texts(found):
        asked.append({x.record_id for x in found.select("record_id").collect()})
        classes = cut_lineage(neardup.text_classes(found, "body"))
        return classes, neardup.similar_pairs(classes, places=neardup.places_of(found, classes))

    def at_slots(judged):
        rows = S.rows_at_slots(judged, grid, ["asset", "horizon"], "first", "last", S.grid_levels(grid))
        return sorted((x.cutoff_at, x.event_id, x.record_id, x.kept) for x in rows.collect())

    whole = news.standing_items
    monkeypatch.setattr(news, "standing_items", lambda i, e: whole(i, e, limit))
    want = at_slots(news.retained_spans(grid, df, *texts(df)))
    got, classes = news.judged_texts(grid, df.drop("body"), texts, bodies=df)
    assert at_slots(got) == want and {x[3] for x in want} == {True, False}
    shown = {x[2] for x in want}
    assert len(shown) < 100 and asked[1] == (shown if limit else asked[0])
    assert classes.count() == len(asked[1])


def test_similar_pairs_equal_all_pairs_and_leave_whole_texts_unshuffled(spark, monkeypatch):
    """Near copies, exact copies, a line in every text and texts of nothing but frequent shingles, with few and with many shingles taken as frequent."""
    r = random.Random(21)
    line, pool = [f"l{i}" for i in range(14)], [f"p{i}" for i in range(9)]
    texts = []
    for i in range(40):
        own = [f"w{i}x{k}" for k in range(r.choice([3, 30, 90]))]
        near = [w if r.random() > 0.02 else f"e{r.randrange(10**6)}" for w in own]
        texts += [own + line, near + line, own + line, [r.choice(pool) for _ in range(r.randrange(1, 9))], line + pool[:i % 9]]
    df = spark.createDataFrame([(str(i), " ".join(t)) for i, t in enumerate(texts)], "record_id string, body string")
    sets = {frozenset(zip(t, t[1:], t[2:], strict=False)) for t in texts} - {frozenset()}
    want = sorted(round(len(a & b) / len(a | b), 9) for a in sets for b in sets if a != b and len(a & b) >= 0.85 * len(a | b))
    classes = cut_lineage(neardup.text_classes(df, "body"))
    for hot, limit, rounds in ((32, 200_000, 8), (1, 200_000, 8), (1, 5, 8), (2, 200_000, 1)):
        for name, value in (("HOT", hot), ("HOT_LIMIT", limit), ("HOT_ROUNDS", rounds)):
            monkeypatch.setattr(neardup, name, value)
        got = neardup.similar_pairs(classes)
        assert sorted(round(x["jaccard"], 9) for x in got.collect()) == want
        assert got.count() == got.select("class_id", "other_id").distinct().count()
    monkeypatch.undo()
    wide = [f for f in neardup.one_per_class(classes)._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in f]
    assert not wide   # whole shingle sets stay where they are


def test_candidates_are_compared_by_groups_and_blocks(spark, monkeypatch):
    """Sets go to a group once, whatever its pairs; groups in blocks of any size give the same pairs, and no set that nobody asks for is shuffled."""
    r = random.Random(23)
    base = [[f"w{i}x{k}" for k in range(60)] for i in range(12)]
    texts = [[w if r.random() > 0.003 else f"e{r.randrange(10**6)}" for w in base[i % 12]] for i in range(120)] + [[f"u{i}x{k}" for k in range(60)] for i in range(80)]
    sets = {i: sorted({zlib.crc32(" ".join(g).encode()) for g in zip(t, t[1:], t[2:], strict=False)}) for i, t in enumerate(texts)}
    df = cut_lineage(spark.createDataFrame([(bytes([i]), s, len(s)) for i, s in sets.items()], "class_id binary, shingles array<bigint>, n int"))
    both = [(bytes([i]), bytes([j]), len(sets[i]), len(sets[j])) for i in sets for j in sets if i < j < 120 and i % 12 == j % 12]
    candidates = spark.createDataFrame(both, "class_id binary, other_id binary, n int, m int")
    alike = lambda i, j: len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j]))
    want = sorted((a, b, alike(a[0], b[0])) for a, b, _, _ in both if alike(a[0], b[0]) >= 0.85)
    assert 100 < len(want) < len(both)
    for shingles, most, bins, limit in ((1 << 20, 1000, 1 << 18, 500_000), (150, 1000, 100, 0), (1 << 20, 3, 1 << 18, 0)):
        for name, value in (("BLOCK_SHINGLES", shingles), ("BLOCK_TEXTS", most), ("BIN_SHINGLES", bins)):
            monkeypatch.setattr(neardup, name, value)
        monkeypatch.setattr(neardup, "small_side", lambda keys, limit=limit: small_side(keys, limit))
        out = neardup.compared(candidates, df, 0.85)
        assert sorted((bytes(x["class_id"]), bytes(x["other_id"]), x["jaccard"]) for x in out.collect()) == want
    assert df.withColumn("x", neardup.listed(candidates)(F.col("class_id"))).where("x").count() < 130


def test_prefixes_settle_frequent_shingles_before_they_are_shuffled(spark, monkeypatch):
    """Texts of many frequent shingles: one count of prefixes is enough, and shingles of one text are not joined."""
    r = random.Random(22)
    lines = [[f"l{i}x{k}" for k in range(12)] for i in range(40)]
    texts = [sum(r.sample(lines, 6), [f"w{i}x{k}" for k in range(60)]) for i in range(200)] + [[f"w{i}x{k}" for k in range(60)] + ["end"] for i in range(9)]
    df = spark.createDataFrame([(str(i), " ".join(t)) for i, t in enumerate(texts)], "record_id string, body string")
    classes = cut_lineage(neardup.text_classes(df, "body"))
    counted = []
    monkeypatch.setattr(neardup, "cut_lineage", lambda d: counted.append(d.columns) or cut_lineage(d))
    sets = neardup.one_per_class(classes)
    left = neardup.prefixes(sets, 0.85).groupBy("s").count()
    assert counted.count(["h", "f"]) == 1
    assert left.agg(F.max("count")).first()[0] <= neardup.HOT and left.where("count = 1").count() < 5


def test_an_event_is_cut_by_its_spans_not_by_its_versions(spark, monkeypatch):
    """500 versions of an event over five different spans make five rows to cut; the newest version of each piece stands for it."""
    rows = [("BTC", "h", "e", i % 5, 9, T0 + timedelta(minutes=i % 97), f"r{i:03d}") for i in range(500)]
    visible = spark.createDataFrame(rows, "asset string, horizon string, event_id string, first long, last long, available_at timestamp, record_id string")
    cut = []
    monkeypatch.setattr(news, "cut_at_changes", lambda d, *a: cut.append(d.count()) or S.cut_at_changes(d, *a))
    got = {(x["first"], x["last"]): x["record_id"] for x in news.event_spans(visible).collect()}
    assert cut == [5]
    want = {}
    for a, b in zip([0, 1, 2, 3, 4], [1, 2, 3, 4, 9], strict=True):
        want[a, b] = max((x[5], x[6]) for x in rows if x[3] <= a)[1]
    assert got == want
