"""Vocabulary and scores against plain counting."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import textmodel


def terms_of(text):
    w = [x for x in (text or "").lower().split() if len(x) > 1]
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def texts(n=60):
    r = random.Random(5)
    word = lambda: "w%d" % min(int(r.expovariate(0.05)), 300)
    return [" ".join(word() for _ in range(r.choice([0, 1, 2, 40, 400]))) for _ in range(n)] + [None, "a b", "zz"]


@pytest.mark.parametrize("size", [1, 40, 200, 5000])
@pytest.mark.parametrize("buckets", [3, 1 << 12])
def test_vocabulary_is_the_most_frequent_terms_for_any_buckets(spark, monkeypatch, size, buckets):
    monkeypatch.setattr(textmodel, "BUCKETS", buckets)
    monkeypatch.setattr(textmodel, "SHARE", 4)
    rows = texts()
    docs = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    total, df = Counter(), Counter()
    for t in rows:
        total.update(terms_of(t))
        df.update(set(terms_of(t)))
    want = [(t, i, round(math.log((1 + len(rows)) / (1 + df[t])) + 1, 9)) for i, t in enumerate(sorted(total, key=lambda t: (-total[t], t))[:size])]
    got = textmodel.build_vocabulary(docs, "text", len(rows), size).collect()
    assert sorted(((x["term"], x["rank"], round(x["idf"], 9)) for x in got), key=lambda x: x[1]) == want


def test_scores_equal_plain_sums_and_texts_are_not_shuffled(spark, monkeypatch):
    """Single, repeated and null keys; texts without words, with one, and more words than are weighed at once."""
    monkeypatch.setattr(textmodel, "WORDS_AT_ONCE", 50)
    rows = [(None if i % 17 == 3 else i // 2 if i < 12 else i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "id long, text string")
    model = textmodel.rule_weights(textmodel.build_vocabulary(docs, "text", len(rows), 50))
    known = {x["term"]: (x["idf"], x["w"]) for x in model.collect()}
    tf = {}
    for k, t in rows:
        if k is not None:
            tf.setdefault(k, Counter()).update(t for t in terms_of(t) if t in known)
    out = textmodel.score(docs, model, "id", "text", F.lit(True))
    want = []
    for k, _ in rows:
        x = {t: (1 + math.log(n)) * known[t][0] for t, n in tf.get(k, {}).items()}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
        z = [sum(v * known[t][1][i] for t, v in x.items()) / norm for i in range(len(textmodel.HEAD_CLASSES))]
        e = [math.exp(v) for v in z[:3]]
        want.append((str(k), round((e[2] - e[0]) / sum(e), 9)))
    assert sorted((str(x["id"]), round(x["sentiment"], 9)) for x in out.collect()) == sorted(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan or "ArrowEvalPython" in plan   # texts are scored where they are read
