"""Operators against plain versions, and the cases each must define: nulls, empty and long texts, ties, repeats, odd columns."""

import hashlib
import os
import random
from math import floor
import re
import tracemalloc
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF
from tidemark.llm import (
    bin_packing,
    byte_bpe,
    langid_ftrl,
    line_winnow,
    paragraph_minhash,
    quality_llr,
    superminhash,
    token_spans,
    toxicity_zstd,
    va_file,
)
from tidemark.llm.bpe import Codec
from tidemark.llm import common
from tidemark.llm import components as components_module
from tidemark.llm.common import rewritten
from tidemark.llm.components import components
from tidemark.llm.links import joining, shared_counts
from tidemark.llm.words import shingle_sets, words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def rng_words(seed, n, vocabulary=4000):
    r = random.Random(seed)
    return ["w%d" % r.randrange(vocabulary) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null keys and texts, empty texts, a long text, repeated rows, and columns whose names operators use inside."""
    long = " ".join(rng_words(1, 30000))
    rows = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en"), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en"),
            (2, None, "en"), (3, "", None), (4, " \n\t ", "de"), (None, "alpha beta gamma delta", "en"), (None, None, None),
            (5, long, "en"), (6, long + " end", None), (7, "123 456 !!", "fr"), (8, "日本語 😀 é́", "fr"), (9, "one\ntwo\nthree", "en"), (10, "one\ntwo\nthree", "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    extra = {c: F.lit("x") for c in ("key", "ids", "bucket", "unit", "node", "shade", "rank", "part", "cut_doc_id", "Cut_Text", "dropped_doc_id", "source")}
    return df.withColumns(extra).withColumn("n_chars", F.length("text").cast("bigint"))


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def docs_of(spark, texts):
    return spark.createDataFrame(list(texts), "doc_id bigint, text string")


# 1

def base_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = defaultdict(list)
    for i in range(len(w) - 4):
        wins[tuple(w[i:i + 5])].append(i)
    cover = {i + k for v in wins.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def test_quality_base_counts_and_edges(spark, odd):
    texts = [(i, t) for i, t in enumerate(["a b c d e a b c d e f", "x\nx\n\n \ny\nx", "#a* <b>", "aa aa aa aa aa aa aa", "é日 😀", "\x0b a\x0cb\x85c\xa0d", None, ""])]
    labels = spark.createDataFrame([(0, 1), (None, 1), (1, None)], "doc_id bigint, quality int")
    for docs in (docs_of(spark, texts), odd):
        rows = quality_llr.judged(docs, labels).collect()
        assert len(rows) == docs.count()
        want = defaultdict(list)
        for r in docs.select("doc_id", "text").collect():
            want[r[0]].append(base_of(r[1]))
        for r in rows:
            assert tuple(r)[1:6] in want[r["doc_id"]]
            assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])
    assert quality_llr.judged(docs_of(spark, texts).limit(0), labels).count() == 0


def test_quality_ratio_rejects_what_trusted_text_never_has(spark):
    good = [(i, " ".join(rng_words(i, 60, 300))) for i in range(40)]
    bad = [(100 + i, " ".join(x + "$$$" for x in rng_words(i, 60, 300))) for i in range(10)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 40, 2)], "doc_id bigint, quality int")
    rows = {r["doc_id"]: r for r in quality_llr.judged(docs_of(spark, good + bad), labels).collect()}
    assert not any(rows[i]["kept"] for i, _ in bad)
    assert min(rows[i]["score"] for i, _ in good) > max(rows[i]["score"] for i, _ in bad)


def test_ngrams_of_a_long_text_do_not_depend_on_cuts(monkeypatch):
    text = " ".join(rng_words(3, 3000)) + "!" * 50
    whole = [x for x in quality_llr.ngram_buckets([text], 1000)][0][3]
    monkeypatch.setattr(quality_llr, "_PIECE", 100)
    assert sorted(whole) == sorted([x for x in quality_llr.ngram_buckets([text], 1000)][0][3])


# 2

def test_bpe_equals_the_rank_library(spark, odd):
    codec = Codec(public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    r = random.Random(5)
    letters = [chr(i) for i in range(32, 0x250)] + list("日本語한국😀́‍ \t\n\r\x0b\x1c\x85\xa0　<unk>") * 20
    texts = ["".join(r.choices(letters, k=r.randint(0, 150))) for _ in range(500)] + ["", "a" * 3000, " " * 200 + "x", "⁇unknown <unk></s>"]
    for t in texts:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()
        assert codec.count(t) == len(ids) // 4
    rows = byte_bpe.encode(odd, with_bytes=True).collect()
    assert len(rows) == odd.count()
    want = sorted((str(x["doc_id"]), x["text"] or "") for x in odd.collect())
    assert sorted((str(x["doc_id"]), x["decoded"].decode()) for x in rows) == want
    again = byte_bpe.decode(byte_bpe.encode(odd)).collect()
    assert sorted(str((x["doc_id"], x["decoded"])) for x in again) == sorted(str((x["doc_id"], x["decoded"])) for x in rows)
    assert byte_bpe.encode(odd.limit(0)).count() == 0


# 3

def test_va_file_equals_brute_force(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(30, 8)).round(2)
    rows = [(i, [float(x) for x in base[i % 30]]) for i in range(400)]
    rows += [(1000, None), (1050, []), (1100, [1.0, None] + [0.0] * 6), (1150, [float("nan")] * 8), (1200, [float("inf")] * 8), (None, [1.0] * 8),
             (0, [float(x) for x in base[0]]), (1250, [1.0, 2.0]), (1300, [1e30] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("v", F.lit(1)).withColumn("b", F.lit(2))
    rows += [(i, [x * 10.0 ** e for x in base[i % 30].tolist()]) for i, e in ((1400, 6), (1401, 6), (1402, 5), (1450, 12), (1451, 12), (1452, 12))] * 2
    rows += [(1401, base[3].tolist())] * 9
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("v", F.lit(1)).withColumn("b", F.lit(2))
    long = 2 ** 63 - 1
    vectors = [(i, [max(-long - 1, min(long, floor(256 * c))) for c in x]) for i, x in rows if i is not None and x and all(c is not None and np.isfinite(c) for c in x)]
    asked = {}
    for i, a in vectors:
        if i % 50 == 0:
            asked[i] = min(a, asked.get(i, a))
    want = []
    for q, a in asked.items():
        scored = sorted((-max(-long, min(long, sum(x * y for x, y in zip(a, b, strict=True)))), i) for i, b in vectors if i != q and len(a) == len(b))[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    for block in (64, 4096):
        assert got(va_file.top_k(va_file.quantised(df), block_rows=block)) == sorted(want, key=str)
    assert va_file.top_k(va_file.quantised(df.limit(0))).count() == 0


def test_va_file_reads_few_exact_vectors():
    r = np.random.default_rng(1)
    exact = (r.normal(size=(4000, 16)) * 100).astype("<i4")
    codes, low, high = va_file.cells_of(exact, 16)
    found = list(va_file.search_block(exact[:50], np.arange(50), exact, np.arange(4000), codes, low, high, 5))
    assert np.mean([f[3] for f in found]) < 600


def test_va_file_goes_on_from_the_best_so_far(spark):
    """Blocks that follow are read above the k-th best score only, and rows leave a task per group of blocks, not per block."""
    r = np.random.default_rng(5)
    exact, ids = (r.normal(size=(12_000, 16)) * 100).astype("<i2"), r.permutation(12_000)
    best, reads = va_file.Best(exact[:60], ids[:60], 5), []
    for at in range(0, len(ids), 2000):
        part = exact[at:at + 2000]
        best.meet(va_file.Block.of(part, ids[at:at + 2000], *va_file.cells_of(part, 16)))
        reads.append(best.read.sum())
    assert np.diff(reads).max() < reads[0] and reads[-1] - reads[-2] < reads[0] / 3
    scores = exact[:60].astype(int) @ exact.T.astype(int)
    scores[np.arange(60), np.arange(60)] = -1 << 60
    order = [sorted(zip(-s, ids, strict=True))[:5] for s in scores]
    assert best.ids.tolist() == [[i for _, i in o] for o in order] and best.scores.tolist() == [[-s for s, _ in o] for o in order]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(exact[:300].tolist())], "vec_id bigint, v array<bigint>")
    want = got(va_file.top_k(df))
    for groups, most, asked in ((1, 100, 32_768), (3, 2, 2), (1, 1, 1)):
        old = va_file.GROUPS, va_file.GROUP_BLOCKS
        va_file.GROUPS, va_file.GROUP_BLOCKS = groups, most
        assert got(va_file.top_k(df, block_rows=20, asked_rows=asked)) == want
        va_file.GROUPS, va_file.GROUP_BLOCKS = old


# 4

def brute_lines(rows, k, span):
    """Lines that must go (in an earlier run of k + span - 1 lines) and lines that may go (in an earlier run of k)."""
    seqs = {d: [(i, x) for i, x in enumerate(t.split("\n")) if x.strip(" \t\n\x0b\x0c\r")] for d, t in rows}

    def repeated(n):
        first, out = {}, defaultdict(set)
        for d in sorted(seqs):
            for i in range(len(seqs[d]) - n + 1):
                key = tuple(x for _, x in seqs[d][i:i + n])
                if key in first:
                    out[d] |= {j for j, _ in seqs[d][i:i + n]}
                first.setdefault(key, 1)
        return out

    return repeated(k + span - 1), repeated(k)


@pytest.mark.parametrize(("k", "span"), [(2, 2), (3, 2), (3, 3)])
def test_line_dedup_deletes_all_long_repeats_and_nothing_unique(spark, k, span):
    r = random.Random(4)
    rows = [(i, "\n".join(r.choice(["a", "b", "c", "", " ", "d%d" % r.randrange(40)]) for _ in range(r.randint(0, 25)))) for i in range(80)]
    must, may = brute_lines(rows, k, span)
    found = defaultdict(set)
    for x in line_winnow.deletions(docs_of(spark, rows), k=k, span=span).collect():
        found[x["doc_id"]].add(x["line"])
        assert x["kept_doc_id"] <= x["doc_id"]
    for d, _ in rows:
        assert must[d] <= found[d] <= may[d]


def test_line_dedup_keeps_columns_and_null_rows(spark, odd):
    out = line_winnow.deduplicated(odd)
    assert out.columns == odd.columns
    ids = sorted(str(x["doc_id"]) for x in out.collect())
    assert ids == sorted(str(x["doc_id"]) for x in odd.collect() if x["doc_id"] != 10)
    assert line_winnow.deduplicated(odd.limit(0)).count() == 0
    some = docs_of(spark, [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny")])
    assert got(line_winnow.deduplicated(some)) == [(1, "a\nb\nc\nd"), (2, "x\ny")]


def test_pipeline_deletes_every_repeated_pair_and_long_single_line(spark):
    r = random.Random(8)
    foot, lines = "this footer stands under every text", ["p%d q%d" % (i, i) for i in range(30)] + ["one two three four five %d" % i for i in range(8)]
    rows = [(i, "\n".join([*(r.choice(lines) for _ in range(r.randrange(1, 9))), f"own {i}", foot, f"end {i}"])) for i in range(60)] + [(99, foot)]
    seen_lines, seen_pairs, want = set(), set(), {}
    for d, text in rows:
        x = text.split("\n")
        gone = {i for i, line in enumerate(x) if line in seen_lines or seen_lines.add(line) if len(line.split()) >= line_winnow.LINE_WORDS}
        for i, pair in enumerate(zip(x, x[1:], strict=False)):
            if pair in seen_pairs:
                gone |= {i, i + 1}
            seen_pairs.add(pair)
        want[d] = "\n".join(line for i, line in enumerate(x) if i not in gone)
    out = corpus_pipeline.line_dedup(spark, docs_of(spark, rows), SF)
    assert got(out) == sorted(((d, t) for d, t in want.items() if t), key=str)
    assert sum(foot in r["text"] for r in out.collect()) == 1


# 5

def test_language_is_told_for_held_out_documents(spark):
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    model = langid_ftrl.fit(langid_ftrl.training_rows(docs))
    out = langid_ftrl.predicted(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(langid_ftrl.held_out(F.col("doc_id")))
    right, total = out.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / total > 0.98


def test_language_edges(spark, odd):
    model = langid_ftrl.fit(langid_ftrl.training_rows(odd))
    rows = {(str(r["doc_id"]), r["lang_pred"] == "und"): r["score"] for r in langid_ftrl.predicted(odd, model).collect()}
    for d in ("2", "3", "4", "7"):
        assert rows[(d, True)] == 0.0
    assert all(0 <= s <= 1 for s in rows.values()) and ("1", False) in rows and ("8", False) in rows
    none = langid_ftrl.fit(langid_ftrl.training_rows(odd.limit(0)))
    assert none.predict("text") == ("und", 0.0)
    assert langid_ftrl.accepted(odd, model, 0.0).columns == odd.columns


def test_gram_counts_do_not_depend_on_cuts(monkeypatch):
    text = "Abc déf 日本 " * 500
    whole = langid_ftrl.gram_counts(text)
    for n in (1, 2, 7, 1000):
        monkeypatch.setattr(langid_ftrl, "_PIECE", n)
        assert (langid_ftrl.gram_counts(text) == whole).all()


def test_ftrl_sparse_and_temperature():
    r = np.random.default_rng(0)
    rows = [(np.array([y, 5 + int(r.integers(20))]), np.array([0.8, 0.6])) for y in (0, 1) for _ in range(60)]
    y = np.repeat([0, 1], 60)
    w = langid_ftrl.train(rows, y, 2, 32, l1=1.0)
    assert (w[5:] == 0).mean() > 0.9 and w[0, 0] > w[0, 1]
    logits = r.normal(size=(4000, 3)) * 2
    target = np.array([r.choice(3, p=p) for p in langid_ftrl.softmax(logits / 3)])
    assert 2.3 < langid_ftrl.temperature(logits, target) < 4


# 6

def test_toxic_words_are_found_in_held_out_documents(spark):
    docs = spark.read.parquet(SF.replace("0.001", "0.1") + "/documents.parquet")
    labels = spark.read.parquet(SF.replace("0.001", "0.1") + "/labels.parquet")
    model = toxicity_zstd.fit(docs.select("doc_id", "text"), labels.where(~toxicity_zstd.held_out(F.col("doc_id"))))
    out = toxicity_zstd.scored(docs, model).join(labels, "doc_id").where(toxicity_zstd.held_out(F.col("doc_id"))).toPandas()
    flagged = out[out.score >= 0.5]
    assert (flagged.toxic == 1).mean() > 0.9
    assert (flagged.toxic == 1).sum() > 0.75 * (out.toxic == 1).sum()


def test_toxicity_edges(spark, odd):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (7, None)], "doc_id bigint, toxic int")
    for use in (labels, labels.where("toxic = 0"), labels.limit(0)):
        model = toxicity_zstd.fit(odd.select("doc_id", "text"), use)
        rows = toxicity_zstd.scored(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity_zstd.windows("A b, c!d", 2) == ["a b", "b c", "c d"]


# 7

def shingle_set(text):
    w = WORD.findall((text or "").encode().lower())
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute_components(rows):
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingle_set(t)) for d, t in rows]
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in parent}


def edited(base, edits, seed):
    r, w = random.Random(seed), list(base)
    for _ in range(edits):
        w[r.randrange(len(w))] = "e%d" % r.randrange(10 ** 6)
    return " ".join(w)


def test_near_duplicates_equal_brute_force(spark):
    rows = []
    for g in range(12):   # groups around the limit of similarity, so buckets hold several components
        base = rng_words(g, 120)
        rows += [(len(rows) + i, edited(base, 1 + i % 7, 100 * g + i)) for i in range(14)]
    shared = rng_words(99, 100)
    rows += [(len(rows) + i, " ".join(shared + rng_words(1000 + i, 20 + i % 9))) for i in range(30)]
    rows += [(len(rows) + i, t) for i, t in enumerate(["a b c", "A  b\tc", "a b", "", None, " ", "a b c d e f g h", "b c d e f g h a"])]
    random.Random(1).shuffle(rows)
    want = brute_components(rows)
    out = {r["doc_id"]: r for r in superminhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert {d: r["component_id"] for d, r in out.items()} == want
    text = dict(rows)
    assert all(r["n_shingles"] == len(shingle_set(text[d])) and r["kept"] == (d == want[d]) for d, r in out.items())


def test_near_duplicates_edges(spark, odd):
    out = superminhash.near_duplicates(odd)
    rows = out.collect()
    assert len(rows) == odd.count()
    of = {r["doc_id"]: r["component_id"] for r in rows}
    assert of[None] is None and of[6] == 5 and of[10] == 9 and of[2] == 2 and of[3] == 3 and of[4] == 4
    assert superminhash.near_duplicates(odd.limit(0)).count() == 0
    kept = superminhash.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "None", "None", "5", "7", "8", "9"])


def test_superminhash_estimates_with_less_variance_and_depends_on_the_set_only():
    r = np.random.default_rng(3)
    errors = []
    for _ in range(80):
        pool = r.integers(0, 2 ** 63, size=60).astype(np.uint64)
        a, b = np.sort(pool[:50]), np.sort(pool[10:])
        s = superminhash.signatures([a, b, a[::-1].copy()], 128)
        assert (s[0] == s[2]).all()
        errors.append((s[0] == s[1]).mean() - 40 / 60)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < np.sqrt(2 / 9 / 128)


def test_words_and_shingles_of_whole_texts(monkeypatch):
    texts = [b"A bc\x0bd\xc3\xa9 e", None, b"", b" x ", b"p q r s t u p q r s t", b"y" * 300 + b" z"]
    whole = [(d, s.tolist()) for w in words(texts) for d, s in shingle_sets(w)]
    assert [len(s) for _, s in whole] == [1, 0, 0, 1, 6, 1]
    monkeypatch.setattr("tidemark.llm.words.PIECE_BYTES", 5)
    assert [(d, s.tolist()) for w in words(texts) for d, s in shingle_sets(w)] == whole


def test_shared_counts_and_joining_in_small_steps():
    r = np.random.default_rng(4)
    left, right = ([np.unique(r.integers(0, 60, size=n)) for n in r.integers(0, 30, size=9)] for _ in range(2))
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    for n in (1, 50, 1 << 20):
        assert shared_counts(left, right, n).tolist() == want
    sets = [np.arange(10), np.arange(10), np.arange(5)]
    assert list(joining(([1, 2, 3], [1, 2, 3], sets), ([1, 2, 3], [1, 2, 3], sets), 75)) == [(1, 2)]


def test_shared_counts_hold_little_memory():
    """Two workers of an executor each count the shared shingles of a large group of near copies."""
    sets = [np.arange(i % 7, 200, dtype=np.int64) for i in range(400)]
    tracemalloc.start()
    found = shared_counts(sets, sets)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6
    assert found.tolist() == [[200 - max(i % 7, j % 7) for j in range(400)] for i in range(400)]


def test_components_of_stars_take_no_round(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(components_module, "_star", lambda *a, star=components_module._star: rounds.append(1) or star(*a))
    edges = [(1, i) for i in range(2, 40)] + [(i, 50) for i in range(51, 60)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert out == {i: 1 for i in range(1, 40)} | {i: 50 for i in range(50, 60)} and not rounds
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8)], "a bigint, b bigint")
    assert {r["node"]: r["component"] for r in components(chain).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8} and rounds


def test_copies_take_the_component_of_their_class(spark, monkeypatch):
    """Copies are no edges of the components; a key with several texts joins their classes."""
    a, b, c, d = (" ".join(rng_words(i, 40)) for i in (1, 2, 3, 4))
    near = " ".join([*a.split()[:-1], "other"])
    rows = [(i, a) for i in range(30, 60)] + [(7, near), (8, b), (70, b), (90, c), (91, c), (70, c), (95, d), (96, d)]
    seen = []
    monkeypatch.setattr(superminhash, "components", lambda e: seen.append(e.count()) or components(e))
    out = {r["doc_id"]: r["component_id"] for r in superminhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert out == {i: 7 for i in range(30, 60)} | {7: 7, 8: 8, 70: 8, 90: 8, 91: 8, 95: 95, 96: 95}
    assert seen and max(seen) < 10
    seen.clear()
    once = {r["doc_id"]: r["component_id"] for r in superminhash.near_duplicates(docs_of(spark, rows[:33])).collect()}
    assert once == {i: 7 for i in range(30, 60)} | {7: 7, 8: 8, 70: 8} and not seen


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 299), (299, 298), (5, 5)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert out == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 298: 298, 299: 298, 300: 298}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 8

def test_passages_of_fifty_words_are_always_caught_and_clean_text_is_left(spark):
    rows = [(i, " ".join(rng_words(i, 150, 10 ** 6))) for i in range(60)]
    for n, at in enumerate(range(0, 40, 4)):   # a passage of 50 words at odd places of two documents
        passage = rng_words(5000 + n, 50, 10 ** 6)
        for d in (at, at + 1):
            w = rows[d][1].split()
            cut = (7 * d) % 140
            rows[d] = (d, " ".join(w[:cut] + passage + w[cut:]))
    out = paragraph_minhash.repeated_spans(docs_of(spark, rows)).collect()
    assert {r["doc_id"] for r in out} == {at + 1 for at in range(0, 40, 4)}
    text = dict(rows)
    for r in out:
        assert r["kept_doc_ids"] == [r["doc_id"] - 1]
        gone, kept = text[r["doc_id"]].encode()[r["start"]:r["end"]].decode().split(), set(text[r["doc_id"] - 1].split())
        assert sum(w not in kept for w in gone) <= 3   # a similar paragraph may reach beyond the passage


def test_every_word_of_a_planted_passage_goes(spark):
    """Passages of 50 to 80 words at the start, inside and at the end of a text, and as the whole text."""
    rows, planted = [], {}
    for i in range(24):
        passage = rng_words(500 + i, 50 + 10 * (i % 4), 10 ** 6)
        own = [rng_words(600 + 4 * i + k, 60, 10 ** 6) for k in range(4)]
        rows.append((2 * i + 1, " ".join(own[0] + passage + own[1])))
        before, after = own[2] if i % 3 else [], own[3] if i % 2 else []
        rows.append((2 * i + 2, "  ".join(before + passage + after)))
        planted[2 * i + 2] = before + after
    found = defaultdict(list)
    for r in paragraph_minhash.repeated_spans(docs_of(spark, rows)).collect():
        assert r["kept_doc_ids"] == [r["doc_id"] - 1]
        found[r["doc_id"]].append(r.asDict())
    for d, text in rows:
        if d in planted:
            left, own = paragraph_minhash.without_spans(text, found[d]).split(), planted[d]
            assert set(left) <= set(own) and len(own) - len(left) <= 6   # a similar paragraph may reach beyond either end
    assert set(found) == set(planted)


def test_passages_grow_by_any_earlier_document(spark):
    """The first document has the middle of the passage only; what the third shares with the second beyond it goes too."""
    passage = rng_words(700, 80, 10 ** 6)
    own = [rng_words(701 + k, 60, 10 ** 6) for k in range(6)]
    rows = [(1, " ".join(own[0] + passage[15:65] + own[1])), (2, " ".join(own[2] + passage + own[3])), (3, " ".join(own[4] + passage + own[5]))]
    left = {r["doc_id"]: r["text"].split() for r in paragraph_minhash.deduplicated(docs_of(spark, rows)).collect()}
    assert not set(left[3]) & set(passage) and len(left[3]) >= 114
    assert set(left[2]) & set(passage) <= set(passage[:15] + passage[65:]) and len(left[2]) >= 144


def test_shared_prefixes_equal_brute_force(spark):
    """Longest first words shared with a class of an earlier document, over all lengths between and beyond those tried first."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        n = int(rng.integers(1, paragraph_minhash.REACH + 1))
        rows.append((i, int(rng.integers(0, 3)), bytes(bytearray(np.where(rng.random(n) < 0.93, 1, 2).astype("<u4").tobytes())), int(rng.integers(0, 60))))
    classes = spark.createDataFrame(rows, "id bigint, part bigint, words binary, first bigint")
    want = {}
    for i, part, own, first in rows:
        best = (0, 0)
        for _, q, other, low in rows:
            if q == part and low < first:
                n = next((k for k in range(min(len(own), len(other)) // 4) if own[4 * k:4 * k + 4] != other[4 * k:4 * k + 4]), min(len(own), len(other)) // 4)
                best = max(best, (n, -low))
        if best[0]:
            want[i] = (best[0], -best[1])
    got = {r["id"]: (r["n"], r["low"]) for r in paragraph_minhash.shared_prefixes(classes).collect()}
    assert got == want


def test_prefixes_are_compared_in_tasks_and_those_of_crowds_by_joins(spark):
    """No row per class and prefix where few classes begin with the same word; both ways and any mixture of them say the same."""
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(0, 3)), bytes(np.where(rng.random(int(rng.integers(1, paragraph_minhash.REACH + 1))) < 0.9, 1, rng.integers(2, 40)).astype("<u4").tobytes()),
             int(rng.integers(0, 60))) for i in range(300)]
    classes = spark.createDataFrame(rows, "id bigint, part bigint, words binary, first bigint")
    few = paragraph_minhash.shared_prefixes(classes)
    assert "Generate" not in few._jdf.queryExecution().executedPlan().toString()
    want = got(few)
    assert len(want) > 100 and got(paragraph_minhash.shared_by_keys(classes)) == want
    for crowd in (1, 3, 40):
        assert got(paragraph_minhash.shared_prefixes(classes, crowd)) == want


def test_texts_are_rewritten_once(spark):
    """The test for words is no second call of Python, which would hold a second worker a task."""
    docs = docs_of(spark, [(1, "a b"), (2, "c"), (3, "d e")])
    marks = docs.where("doc_id < 3").select("doc_id", F.xxhash64("text").alias("text_key"), F.array(F.lit(1)).alias("cut"))
    out = rewritten(docs, marks, lambda t, cut: t[1:], "doc_id", "text")
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, " b"), (3, "d e")]


def test_documents_without_cuts_are_not_shuffled(spark, odd, monkeypatch):
    """A list of cuts that is too long for a broadcast: only documents that it may name are joined, with the same rows."""
    marks = odd.where("doc_id in (1, 5, 9)").select("doc_id", F.xxhash64("text").alias("text_key"), F.array(F.lit(1)).alias("cut")).distinct()
    marks = marks.unionByName(spark.createDataFrame([(7, 0, [1])], "doc_id bigint, text_key bigint, cut array<int>"))
    want = got(rewritten(odd, marks, lambda t, cut: t[1:], "doc_id", "text"))
    monkeypatch.setattr(common, "REWRITE_ROWS", 0)
    out = rewritten(odd, marks, lambda t, cut: t[1:], "doc_id", "text")
    assert got(out) == want and len(want) == odd.count()
    joined = out._jdf.queryExecution().optimizedPlan().toString()
    assert joined.startswith("Union") and joined.count("Join") == 1


def test_sets_are_chosen_where_texts_are_read(spark, monkeypatch):
    """Neither texts nor sets that nobody asked for are shuffled, however many documents and nodes there are."""
    base = rng_words(78, 300, 10 ** 6)
    docs = docs_of(spark, [(1, " ".join(base))] + [(i, edited(base, 3, i)) for i in range(2, 9)] + [(i, " ".join(rng_words(i, 300, 10 ** 6))) for i in range(20, 60)])
    met, sets = [], paragraph_minhash.unit_sets
    monkeypatch.setattr(paragraph_minhash, "unit_sets", lambda rows, *a: met.append((rows, sets(rows, *a))) or met[-1][1])
    want = got(paragraph_minhash.repeated_spans(docs))
    monkeypatch.setattr(paragraph_minhash, "HOLDERS", 0)
    assert got(paragraph_minhash.repeated_spans(docs)) == want and want
    for rows, some in met:
        assert some.count() < sets(docs, paragraph_minhash.WORDS, paragraph_minhash.SPAN).count() / 2
        assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()


def test_passages_with_long_gaps_go_to_their_ends(spark):
    """Distances of more than two bytes to the ends of a passage."""
    words_ = rng_words(79, 70, 10 ** 6)
    passage = " ".join(words_[:3]) + " " * 70_000 + " ".join(words_[3:66]) + " " * 70_000 + " ".join(words_[66:])
    rows = [(i, " ".join(rng_words(90 + i, 60, 10 ** 6)) + " " + passage + " " + " ".join(rng_words(95 + i, 60, 10 ** 6))) for i in (1, 2)]
    out = {r["doc_id"]: r["text"] for r in paragraph_minhash.deduplicated(docs_of(spark, rows)).collect()}
    assert out[1] == rows[0][1] and out[2].split() == rng_words(92, 60, 10 ** 6) + rng_words(97, 60, 10 ** 6)


def test_units_that_no_join_asks_for_stay_in_the_task(spark):
    rng = random.Random(31)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([30, 120, 300]))) for _ in range(40)]
    rows = docs_of(spark, list(enumerate(texts + texts[:5]))).select("doc_id", "text")
    for f in (paragraph_minhash.occurrences, paragraph_minhash.surroundings):
        whole = f(rows, paragraph_minhash.WORDS, paragraph_minhash.SPAN)
        asked = whole.where("doc_id >= 40").select("unit").distinct()
        some = f(rows, paragraph_minhash.WORDS, paragraph_minhash.SPAN, paragraph_minhash.bits_of(asked))
        want = sorted(map(str, whole.join(asked, "unit").collect()))
        assert sorted(map(str, some.join(asked, "unit").collect())) == want
        assert 0 < len(want) <= some.count() < whole.count() / 2
        assert f(rows, paragraph_minhash.WORDS, paragraph_minhash.SPAN, paragraph_minhash.bits_of(asked.limit(0))).count() == 0


def test_edited_passages_join_one_component(spark):
    base = rng_words(77, 400, 10 ** 6)
    rows = [(1, " ".join(base))] + [(i, edited(base, 3, i)) for i in range(2, 12)]
    out = paragraph_minhash.deduplicated(docs_of(spark, rows)).collect()
    left = {r["doc_id"]: len(r["text"].split()) for r in out}
    assert left[1] == 400 and all(left.get(i, 0) < 150 for i in range(2, 12))


def test_passage_edges(spark, odd):
    out = paragraph_minhash.deduplicated(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    assert sum(r["doc_id"] is None for r in rows) == 2 and sum(r["doc_id"] == 1 for r in rows) == 2
    assert len([r for r in rows if r["doc_id"] == 6 and len(r["text"]) > 1000]) == 0
    assert paragraph_minhash.repeated_spans(odd.limit(0)).count() == 0


# 9

def test_section_tokens_add_up_and_cross_by_the_rule(spark, odd):
    rows = token_spans.section_tokens(odd).collect()
    codec = Codec(public_tokenizers.path(token_spans.VOCABULARY), public_tokenizers.PATTERN)
    want, have = defaultdict(int), defaultdict(int)
    for r in odd.select("doc_id", "text").collect():
        want[r[0]] += codec.count(r[1] or "")
    for r in rows:
        have[r["doc_id"]] += r["n_tokens"]
    assert {k: v for k, v in want.items() if v} == dict(have)
    assert token_spans.section_tokens(odd.limit(0)).count() == 0
    n, crossing = token_spans.allocate(np.array([0, 3, 5]), np.array([3, 5, 9]), np.array([0, 4, 6]))
    assert n.tolist() == [2, 0, 1] and crossing.tolist() == [1, 0, 1]


def test_token_spans_cover_whole_characters():
    codec = Codec(public_tokenizers.path(token_spans.VOCABULARY), public_tokenizers.PATTERN)
    for text in ("é日😀 a\n\nb", "plain text\n", "\n", "한국어"):
        starts, ends = codec.spans(text)
        owner = [i for i, c in enumerate(text) for _ in c.encode()]
        at = 0
        for s, e, token in zip(starts, ends, np.frombuffer(codec.encode(text), "<u4").tolist(), strict=True):
            n = len(codec.bytes_of[token])
            assert (s, e) == (owner[at], owner[at + n - 1] + 1)
            at += n
        assert token_spans.line_starts(text).tolist() == [0] + [i + 1 for i, c in enumerate(text[:-1]) if c == "\n"]


# 10

def plain_pack(sizes, lengths, overhead, largest):
    """Best fit by looking at all open bins and all sizes left."""
    order, bins = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), []

    def small(used):
        return min(c for c in lengths if c >= used)

    def in_thought(c, n):
        used = 0
        for i in order[n:]:
            used += sizes[i] if used + sizes[i] <= c else 0
        return (small(used) + overhead) / used, -c

    for n, i in enumerate(order):
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= sizes[i]]
        if not fits:
            wide = [c for c in lengths if c >= sizes[i]]
            cap = max(min(wide), largest) if largest else min(wide, key=lambda c: in_thought(c, n))
            bins.append({"room": cap, "items": [], "used": 0})
            fits = [(cap, len(bins) - 1)]
        b = bins[min(fits)[1]]
        b["room"] -= sizes[i]
        b["used"] += sizes[i]
        b["items"].append(i)
    return [(small(b["used"]), b["items"]) for b in bins]


def test_packing_equals_the_plain_version_and_wastes_little():
    r = random.Random(8)
    for _ in range(30):
        sizes = [min(512, int(r.expovariate(1 / 90)) + 1) for _ in range(r.randint(0, 200))]
        plain = [plain_pack(sizes, (64, 128, 256, 512), 4, largest) for largest in (None, 512, 256, 128, 64)]
        assert bin_packing.pack(sizes, (64, 128, 256, 512), 4) == min(plain, key=lambda bins: sum(c + 4 for c, _ in bins))
    bins = bin_packing.pack([r.randint(1, 3000) for _ in range(5000)])
    assert sum(c for c, _ in bins) < 8_000_000


def test_packing_weighs_all_lengths():
    """A case whose least cost needs three lengths, and small sets against all ways to divide them."""
    assert bin_packing.cost_of(bin_packing.pack([1882, 2616, 289, 2296, 4027, 6687, 3235])) == 22592

    def least(sizes):
        if not sizes:
            return 0
        first, rest, best = sizes[0], sizes[1:], None
        for mask in range(1 << len(rest)):
            used = first + sum(x for k, x in enumerate(rest) if mask >> k & 1)
            if used <= max(bin_packing.LENGTHS):
                here = min(c for c in bin_packing.LENGTHS if c >= used) + bin_packing.OVERHEAD
                cost = here + least([x for k, x in enumerate(rest) if not mask >> k & 1])
                best = cost if best is None else min(best, cost)
        return best

    r, dearer, worst = random.Random(3), 0, 1.0
    for _ in range(100):
        sizes = [min(8192, int(r.lognormvariate(7.5, 0.8)) + 1) for _ in range(6)]
        share = bin_packing.cost_of(bin_packing.pack(sizes)) / least(sizes)
        dearer, worst = dearer + (share > 1), max(worst, share)
    assert dearer <= 8 and worst < 1.25, (dearer, worst)


def test_packing_edges_and_pieces(spark):
    rows = [(1, 100), (1, 100), (2, None), (3, 0), (4, -5), (5, 20000), (None, 30)]
    out = bin_packing.best_fit(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")).toPandas()
    assert sorted(out.fillna(-1).groupby("doc_id")["size"].sum().items()) == [(-1, 30), (1, 200), (5, 20000)]
    assert out[out.doc_id == 5].sort_values("piece").piece_start.tolist() == [0, 8192, 16384]
    for _, b in out.groupby(["shard", "bin"]):
        assert b["size"].sum() == b["used"].iloc[0] <= b["capacity"].iloc[0] and sorted(b["place"]) == list(range(len(b)))
        assert b["capacity"].iloc[0] == min(c for c in bin_packing.LENGTHS if c >= b["used"].iloc[0])
    assert bin_packing.best_fit(spark.createDataFrame([], "doc_id bigint, n_tokens bigint")).count() == 0


# pipeline

def test_pipeline_stages_keep_columns_and_take_effect(spark, odd, folder):
    docs = odd
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i < 4:
            assert docs.columns == before.columns, name
            assert docs.count() <= before.count()
        else:
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()}


def sizes_of(batches):
    for b in batches:
        yield pa.record_batch({"n": [b.num_rows]})


@pytest.mark.parametrize("name, rows, most", [("language_id", 10_000, 1_000), ("line_dedup", 0, 1_000), ("line_dedup", 300, 300)])
def test_pipeline_stages_hand_few_texts_to_a_worker_at_once(spark, name, rows, most):
    """A batch of whole texts is held several times, so its rows bound a worker's memory; a smaller setting of the session holds."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    docs = spark.range(0, 2_500, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("the line "), "id").alias("text"), F.lit("en").alias("lang"))
    try:
        spark.conf.set(setting, rows)
        dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
        sizes = docs.mapInArrow(sizes_of, "n bigint").collect()
    finally:
        spark.conf.set(setting, before)
    assert sum(r["n"] for r in sizes) == 2_500 and max(r["n"] for r in sizes) == most


def test_pipeline_runs_over_whole_documents(spark):
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    packed = corpus_pipeline.run(spark, SF).toPandas()
    exact = defaultdict(list)
    for d, t in source.items():
        exact[t].append(d)
    assert set(packed.doc_id) <= set(source)
    for same in exact.values():   # exact copies never survive twice
        assert len(set(same) & set(packed.doc_id)) <= 1
    assert len(set(packed.doc_id)) > 0.85 * len(exact)


def test_the_rest_does_not_import_this_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for base, folders, files in os.walk(root):
        folders[:] = [f for f in folders if f not in ("llm", ".git", "__pycache__")]
        for f in files:
            if f.endswith(".py") and f not in ("corpus_pipeline.py", "__spark_entry__.py"):
                with open(os.path.join(base, f)) as text:
                    assert "tidemark.llm" not in text.read(), f


def test_digests_of_the_encoding_query(spark):
    out = {r["doc_id"]: r for r in byte_bpe.op2_byte_bpe(spark, SF).collect()}
    for d, t in duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall():
        assert out[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_pipeline_line_dedup_winnows(spark, monkeypatch):
    """The stage takes its fingerprints from windows; the exact pass adds only what they leave."""
    r = random.Random(12)
    for _ in range(200):
        text = "\n".join(r.choice(["a b c d e f", "g", "h i", "", "one two three four five", "k%d" % r.randrange(9)]) for _ in range(r.randrange(12)))
        chosen = line_winnow.fingerprints(text)
        rest = line_winnow.unchosen(text, line_winnow.LINE_WORDS, chosen)
        lines = [i for i, x in enumerate(text.split("\n")) if x.strip()]
        pairs = sorted(tuple(x[2]) for x in chosen + rest if len(x[2]) == 2)
        assert pairs == sorted(zip(lines, lines[1:], strict=False))   # each pair once, chosen or not
        assert not {(x[0], x[1]) for x in chosen} & {(x[0], x[1]) for x in rest}
    docs = docs_of(spark, [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny")])
    monkeypatch.setattr(line_winnow, "unchosen", lambda text, least, chosen: [])
    assert got(corpus_pipeline.line_dedup(spark, docs, SF)) == [(1, "a\nb\nc\nd"), (2, "x\ny")]   # windows and extensions alone find the run
