"""Operator 13 against brute force: suffix trees, runs, and the query over whole documents."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tests.conftest import SF
from tidemark.llm import periodic_runs as pr
from tidemark.llm.suffix_tree import Extensions


def plain_runs(w, least=12):
    """Every maximal stretch of every period, smallest periods only."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q) and not any(w[s:i + q - d] == w[s + d:i + q] for d in range(1, q)):
                out.append((s, i + q - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(r, size, kinds):
    w = []
    while len(w) < size:
        w += [r.randrange(kinds) + 1 for _ in range(r.randrange(1, 20))] * r.randrange(1, 6)
    return w


@pytest.mark.parametrize("kinds", [1, 2, 3, 40])
def test_runs_equal_brute_force(kinds):
    r = random.Random(kinds)
    for _ in range(250):
        w = periodic_words(r, r.choice([0, 3, 12, 40, 120]), kinds)
        assert [tuple(x) for x in pr.runs(np.array(w, np.int64)).tolist()] == plain_runs(w)
        assert [tuple(x) for x in pr.runs(np.array(w, np.int64), 4).tolist()] == plain_runs(w, 4)


def test_fibonacci_words_hold_all_their_runs():
    a, b = [1], [1, 2]
    while len(b) < 400:
        a, b = b, b + a
    assert [tuple(x) for x in pr.runs(np.array(b)).tolist()] == plain_runs(b)


def test_extensions_and_ranks():
    r = random.Random(5)
    for size, kinds in ((1, 1), (7, 1), (90, 2), (400, 3), (300, 100)):
        w = [r.randrange(kinds) + 1 for _ in range(size)]
        tree = Extensions(np.array(w))
        whole = [*w, 0]
        assert sorted(range(size + 1), key=lambda i: whole[i:]) == np.argsort(tree.rank).tolist()
        pairs = [(i, j) for i, j in ((r.randrange(size + 1), r.randrange(size + 1)) for _ in range(500)) if i != j]
        if pairs:
            got = tree.common(*map(np.array, zip(*pairs, strict=True)))
            for (i, j), n in zip(pairs, got.tolist(), strict=True):
                assert whole[i:i + n] == whole[j:j + n] and whole[i + n] != whole[j + n]


def test_one_very_long_run():
    w = np.array([5, 6, 7] * 40_000 + [8])
    assert pr.runs(w).tolist() == [[0, 120_000, 3]]


def row_of(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    ids = {}
    runs = plain_runs([ids.setdefault(x, len(ids)) for x in w])
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force_on_short_documents(spark):
    df = pr.op13_periodic_runs(spark, SF)
    assert df.columns == COLUMNS
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in df.collect()}
    assert len(got) == len(docs)
    for d in docs:
        if len(d.text or "") < 6000:
            assert got[d.doc_id] == row_of(d.doc_id, d.text)


def test_query_on_edge_cases(spark, folder):
    chosen = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    some = " ".join(f"w{i % 17} é{i % 5}" for i in range(120))
    rows = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "a b " * 40), (4, "a b " * 40), (None, "x " * 30), (None, None), (5, "x" * 100_000), (6, "a\x85b " * 20)]
    rows += [(i, some) for i in chosen] + [(chosen[0], None), (chosen[1], " "), (chosen[2], "one"), (-10, some)]
    rows += [(20, "a b c d e f " * 2), (21, "a b c d e f " * 2 + "a"), (22, "a b c d e f g " * 2), (23, "z z z z z z q q q q q q z z z z z z q q q q q q"), (24, "a " * 11)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", *(f"'?' AS {c}" for c in ("h", "w", "a", "p", "runs", "best", "collapsed")))
    docs.write.parquet(f"{folder}/documents.parquet")
    got = sorted(map(tuple, pr.op13_periodic_runs(spark, folder).collect()), key=str)
    assert got == sorted((row_of(*r) for r in rows), key=str)


def test_query_on_an_empty_table(spark, folder):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    assert pr.op13_periodic_runs(spark, folder).collect() == []


def test_collapsed_text_and_spans(spark):
    docs = spark.createDataFrame([(1, "say a b c " + "x y " * 9 + "x end")], "doc_id bigint, text string")
    r = pr.periodic_runs(docs).first()
    assert (r.n_words, r.collapsed, [tuple(x) for x in r.runs]) == (24, "say a b c x y end", [(4, 19, 2)])
