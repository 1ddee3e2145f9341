"""Operator 11 against a plain count over documents, and its edge cases."""

import itertools
import random
import re
from collections import Counter

from tidemark.llm import filter_audit as fa

LABELS = "doc_id bigint, quality int, toxic int"


def plain(rows, labels):
    """Counts by walking every order for every document."""
    texts = {}
    for i, t, _ in rows:
        if i is not None:
            texts[t or ""] = min(i, texts.get(t or "", i))
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    out = Counter()
    for i, t, part in rows:
        t, part = t or "", part or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > texts[t]}
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                at = (part, order, step)
                out[at, "redundant"] += gone and fails[f]
                removed = not gone and fails[f]
                gone = gone or fails[f]
                out[at, "kept"] += not gone
                out[at, "removed"] += removed
                out[at, "good_lost"] += removed and i in good
                out[at, "toxic_lost"] += removed and i in toxic
                out[at, "unique_fails"] += fails[f] and sum(fails.values()) == 1
                out[part, f, "shapley"] += removed
    return out


def check(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = fa.audit(fa.mask_counts(docs, spark.createDataFrame(labels, LABELS))).collect()
    want = plain(rows, labels)
    parts = {p or "" for _, _, p in rows}
    assert len(got) == len({(r.part, r.filter_order, r.step) for r in got}) == 600 * len(parts)
    for r in got:
        for c in fa.COUNTS:
            key = (r.part, r.filter_order[r.step - 1], c) if c == "shapley" else ((r.part, r.filter_order, r.step), c)
            assert r[c] == want[key], (r, c)


def test_audit_equals_plain_count(spark):
    r = random.Random(3)
    base = [" ".join(r.choice(["a", "Bc", "D", "e%", "f", "ğ", "日本"] + [f"w{i}" for i in range(300)]) for _ in range(r.choice([0, 5, 199, 200, 260]))) for _ in range(25)]
    rows = [(r.randrange(60), r.choice(base), r.choice(["en", "de", None, "", "fr"])) for _ in range(120)]
    rows += [(None, base[0], "en"), (None, base[0], None), (None, None, "xx"), (7, None, None), (8, "", "en"), (3, "\x0b \n", "en")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(50)] + [(1, 1, 0), (1, 0, 1), (None, 1, 1), (None, 1, 1)]
    check(spark, rows, labels)


def test_audit_boundaries_of_the_filters(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words[:200]), "a"), (2, " ".join(words[:199]), "a"), (3, " ".join(words[:150] * 2), "a"), (4, " ".join((words[:100] * 3)[:201]), "a"),
            (5, "A" * 3 + "x" * 97, "a"), (6, "A" * 4 + "x" * 96, "a"), (7, "x&", "b"), (8, "x", "b"), (8, "x", "b"), (9, "x", "c")]
    check(spark, rows, [])


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, mask int, digest string")
    assert fa.audit(fa.mask_counts(docs, spark.createDataFrame([], LABELS))).collect() == []


def test_audit_ignores_columns_with_its_own_names(spark):
    docs = spark.createDataFrame([(1, "x", "en")], "doc_id bigint, text string, lang string").selectExpr(
        "*", *(f"'?' AS {c}" for c in ("part", "mask", "digest", "n", "first", "good", "toxic", "originals", "filter_order")))
    assert fa.audit(fa.mask_counts(docs, spark.createDataFrame([], LABELS))).count() == 600


def test_wide_fields_do_not_run_over():
    many = (1 << 62) + 12345
    total = sum(fa.packed(m) * (many // 32) for m in range(32))
    fields = fa.unpacked(total)
    seen = sum(fa.unpacked(fa.packed(m)) for m in range(32))
    assert (fields == seen * (many // 32)).all()
    assert (seen[:, 0] + seen[:, 1] + seen[:, 2] <= 32).all()
