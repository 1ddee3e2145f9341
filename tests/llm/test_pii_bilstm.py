"""Operator 12: rules against the plain patterns, the network against numeric and brute-force results, spans of whole texts, held-out recall."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tests.conftest import SF
from tidemark.llm import pii_bilstm as pii
from tidemark.llm.lstm_crf import Tagger
from tidemark.llm.pii_bilstm import Span

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_rules(text):
    out = []
    for kind, (name, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": name == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "phone": 9 <= len(d) <= 15, "card": 13 <= len(d) <= 19}[name]
            if good and name == "card":
                good = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
            if good:
                out.append(Span(kind, *m.span()))
    return out


@pytest.mark.parametrize("alphabet", ["a1@.-_ ", "0123456789.", "12+ ().-", "a@b.c+%é", "0 -5", "255.1. +("])
def test_rules_equal_plain_patterns(alphabet):
    r = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(45)))
        assert pii.rule_spans(text) == plain_rules(text), text


def test_rules_take_linear_time_on_long_runs():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "@" * 200_000, "a@" * 150_000, "1.1.1 " * 50_000, "a" * 100_000 + "@"):
        pii.rule_spans(text)


def small():
    allowed = np.ones((3, 3), bool)
    allowed[0, 2] = False
    t = Tagger(5, 4, allowed, np.array([True, True, False]), seed=3)
    t.params = {k: v.astype(float) for k, v in t.params.items()}
    return t


def test_gradients_equal_differences():
    t, rng = small(), np.random.default_rng(0)
    cls, tags = rng.integers(0, 5, (7, 3)), np.zeros((7, 3), int)
    tags[2], tags[3], tags[5, 1] = 1, 2, 1
    grads = t.gradients(cls, tags)[1]
    for k, p in t.params.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p.shape)
            if (k == "trans" and t.barred[at]) or (k == "start" and t.barred_start[at]):
                continue
            keep, ends = p[at], []
            for e in (5e-3, -5e-3):
                p[at] = keep + e
                ends.append(t.gradients(cls, tags)[0])
            p[at] = keep
            assert abs((ends[0] - ends[1]) / 1e-2 - grads[k][at]) < 2e-3


def test_viterbi_and_likelihood_equal_enumeration():
    t, rng = small(), np.random.default_rng(1)
    t.params["bias"][0] = 0
    cls = rng.integers(0, 5, (6, 4))
    emit = t.emissions(cls).astype(float)
    trans, start, end = (x.astype(float) for x in t.transitions())
    tags = t.decode(emit)
    for b in range(4):
        def value(path):
            return start[path[0]] + end[path[-1]] + sum(emit[i, k, b] for i, k in enumerate(path)) + sum(trans[a, c] for a, c in zip(path, path[1:], strict=False))

        paths = list(itertools.product(range(3), repeat=6))
        values = np.array([value(p) for p in paths])
        assert abs(value(tuple(tags[:, b])) - values.max()) < 1e-4
        want = np.logaddexp.reduce(values) - value(tuple(tags[:, b]))
        assert abs(t.gradients(cls[:, [b]], tags[:, [b]])[0] - want) < 1e-4


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.fit(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.fixture(scope="module")
def texts(spark):
    return [r[0] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]


def test_loss_falls(tagger):
    assert tagger.losses[-1] < 0.1 * tagger.losses[0]


def test_proof_of_outside_holds(tagger, texts):
    cls = np.stack([pii.classes_of((t + " " * 384)[:384]) for t in texts], axis=1).astype(np.intp)
    emit = tagger.emissions(cls)
    sure = tagger.surely_outside(emit)
    assert sure.mean() > 0.8 and not tagger.decode(emit[:, :, sure]).any()


def planted(texts, n, seed):
    r, rows = random.Random(seed), []
    while len(rows) < n:
        text = r.choice(texts)[:5000]
        at = r.randrange(len(text) + 1)
        while at and text[at - 1] not in " \n":
            at -= 1
        kind = len(rows) % 4
        new = pii._email(r, "".join(r.choice("abcdefgh") for _ in range(5))) if not kind else (None, pii._ip, pii._card, pii._phone)[kind](r)
        if kind == 2:
            new = next((x for x in (new[:-1] + c for c in "0123456789") if pii.luhn(pii.digits_of(x))), new)
        rows.append((text[:at] + new + " " + text[at:], Span(kind, at, at + len(new))))
    return rows


def test_held_out_forms_are_found(tagger, texts):
    rows = planted(texts, 800, 99)
    seen, hits = [0] * 4, [0] * 4
    for (text, want), tagged in zip(rows, pii.tagged_spans([t for t, _ in rows], tagger), strict=True):
        base = pii.rule_spans(text)
        every = pii.all_spans(text, base, tagged)
        assert set(base) <= set(every)
        if want not in base:
            seen[want.kind] += 1
            hits[want.kind] += any(s.kind == want.kind and s.start < want.end and want.start < s.end for s in every)
    assert min(seen) > 50 and min(h / n for h, n in zip(hits, seen, strict=True)) > 0.7, (hits, seen)


def test_clean_texts_are_left_alone(tagger, texts):
    clean = [t for t in texts if not pii.rule_spans(t)]
    added = [s for t, tagged in zip(clean, pii.tagged_spans(clean, tagger), strict=True) for s in pii.all_spans(t, [], tagged)]
    assert len(added) <= len(clean) // 50


def test_spans_do_not_depend_on_window_edges(tagger, texts):
    filler = next(t for t in texts if len(t) > 3000 and not re.search("[0-9@]", t[:1500]))
    value, found = "10[.]20[.]30[.]40", []
    for shift in range(0, 700, 9):
        text = filler[:shift].rsplit(" ", 1)[0] + " " + value + " " + filler[shift:1500]
        spans = pii.all_spans(text, pii.rule_spans(text), pii.tagged_spans([text], tagger)[0])
        found.append(value in [text[s.start:s.end] for s in spans])
    assert sum(found) >= 0.9 * len(found)


def test_reconciling_unites_halves_and_keeps_the_best_set():
    f = pii._Found
    assert pii.reconciled([f(0, 10, 50, 30.0, False, True), f(0, 40, 60, 20.0, True, False)]) == [Span(0, 10, 60)]
    assert pii.reconciled([f(1, 5, 20, 30.0, False, False)] * 2) == [Span(1, 5, 20)]
    assert pii.reconciled([f(0, 0, 10, 20.0, False, False), f(1, 5, 30, 35.0, False, False), f(2, 25, 40, 20.0, False, False)]) == [Span(0, 0, 10), Span(2, 25, 40)]
    assert pii.reconciled([f(0, 0, 10, 1.0, False, False)]) == []


def test_plausible_values():
    yes = [(0, "jo at mail dot example dot org"), (0, "jo.b[at]web(dot)de"), (1, "10[.]0[.]0[.]255"), (2, "4111.1111.1111.1111"), (3, "(509) 555-6973"), (3, "0049 30 1234567")]
    no = [(0, "look at the dot"), (0, "a@b"), (1, "10[.]0[.]0[.]256"), (1, "1.2.3"), (2, "4111.1111.1111.1112"), (2, "0000.0000.0000.0000"), (3, "555-6973"), (3, "2024-01-22")]
    assert all(pii.plausible(*x) for x in yes) and not any(pii.plausible(*x) for x in no)


def test_edge_cases(spark, tagger):
    long = "word " * 60_000 + "write to jo at mail dot example dot org please " + "word " * 1000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "é日😀 jo.4@mail.example.com"), (4, "é日😀 jo.4@mail.example.com"), (None, "1.2.3.4"), (None, None), (5, long), (6, "9" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", *(f"'?' AS {c}" for c in ("spans", "kind", "start", "shade", "place", "from")))
    got = pii.digests(pii.private_spans(docs, tagger)).collect()
    assert len(got) == len(rows)
    assert [r.spans for r in got if r.doc_id == 4] == ["email:4:25"] * 2
    assert [r.n_ip for r in got if r.doc_id is None] in ([1, 0], [0, 1])
    assert all((r.n_email, r.spans) == (0, "") for r in got if r.doc_id in (1, 2, 3, 6))
    assert [long[int(a):int(b)] for r in got if r.doc_id == 5 for k, a, b in [r.spans.split(",")[0].split(":")]] == ["jo at mail dot example dot org"]
    assert pii.private_spans(docs.limit(0), tagger).collect() == []
    assert len(pii.contexts_of(docs)) == 6 and pii.contexts_of(docs.limit(0)) == []


def test_query_counts_and_digests(spark):
    df = pii.op12_pii_bilstm(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in df.collect()}
    assert len(got) == len(docs) and df.columns == ["doc_id", *(f"n_{k}" for k in PATTERNS), "n_added", "base_sha256", "spans"]
    for d in docs:
        base, r = plain_rules(d.text or ""), got[d.doc_id]
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s.kind == i for s in base) for i in range(4)]
        written = [f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in base]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(r.spans.split(",")) | {""} and r.n_added == len([x for x in r.spans.split(",") if x]) - len(base)
