"""Boosted trees by histograms against a plain version, and the choice of a setting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting as B
from tidemark.operators import training


def data(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(3)
    y = (x[:, 0] + 0.5 * rng.normal(size=n) > 0.3).astype(int) + (x[:, 1] + 0.5 * rng.normal(size=n) > 0.2)
    x[rng.random((n, 4)) < 0.05] = np.nan
    return x, y


def frames(spark, x, y, folds):
    rows = spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y, strict=True))], "row_id bigint, y int, features array<double>")
    return rows, spark.createDataFrame([(i, f, role) for f, parts in folds.items() for role, ids in parts.items() for i in ids], "row_id bigint, fold int, role string")


def plain_fit(bins, y, row, s, rounds):
    """Scores of all rows after every round, trees grown node by node over every cut and side of missing values."""
    scores, out = np.zeros((len(bins), 3)), []
    for round_ in range(rounds):
        p = B.softmax(scores)
        use = B.sampled_rows(row, s, round_)
        step = np.zeros_like(scores)
        for k in range(3):
            g, h = p[:, k] - (y == k), np.maximum(2 * p[:, k] * (1 - p[:, k]), 1e-16)

            def grow(members, depth):
                mine = members & use
                if depth < s.max_depth and mine.any():
                    best = (1e-9, None)
                    gs, hs = g[mine].sum(), h[mine].sum()
                    for f in B.sampled_features(bins.shape[1], s, round_).tolist():
                        for cut in sorted(set(bins[mine, f].tolist()) - {B.MISSING}):
                            for missing_left in (True, False):
                                low = np.where(bins[:, f] == B.MISSING, missing_left, bins[:, f] <= cut)
                                a, b = mine & low, mine & ~low
                                if h[a].sum() >= s.min_child_weight and h[b].sum() >= s.min_child_weight:
                                    gain = round(sum(g[q].sum() ** 2 / (h[q].sum() + s.reg_lambda) for q in (a, b)) - gs ** 2 / (hs + s.reg_lambda), 9)
                                    key = (gain, -f, -cut, missing_left)
                                    if gain > 0 and (best[1] is None or key > best[0]):
                                        best = (key, low)
                    if best[1] is not None:
                        grow(members & best[1], depth + 1)
                        grow(members & ~best[1], depth + 1)
                        return
                step[members, k] = -s.learning_rate * g[mine].sum() / (h[mine].sum() + s.reg_lambda)

            grow(np.ones(len(bins), bool), 0)
        scores = scores + step
        out.append(scores)
    return out


def test_trees_equal_a_plain_version(spark):
    x, y = data(400)
    train, valid = list(range(300)), list(range(300, 400))
    rows, roles = frames(spark, x, y, {1: {"train": train, "validation": valid}, 2: {"train": list(range(100, 400)), "validation": list(range(100))}})
    settings = [B.Setting(2, 0.3, 2.0, reg_lambda=1.0), B.Setting(3, 0.2, 5.0, seed=9)]
    edges = B.bin_edges(rows)
    table = B.prepare(rows, roles, edges)
    experts = B.fit_experts(table, 4, [1, 2], settings, rounds=3)
    bins = B.binned(x, edges)
    assert len(experts) == 4
    for e in experts:
        ids = np.array(train if e.fold == 1 else range(100, 400))
        others = np.array(valid if e.fold == 1 else range(100))
        want = plain_fit(bins[ids], y[ids], ids, e.setting, 3)
        for n in (1, 2, 3):
            assert np.allclose(e.scores(bins[ids], n), want[n - 1], atol=1e-9)
        losses = [-np.log(B.softmax(e.scores(bins[others], n))[np.arange(len(others)), y[others]]).mean() for n in range(4)]
        assert np.allclose(e.losses, losses) and e.best == int(np.argmin(losses))
        assert losses[-1] < losses[0]


def test_out_of_fold_rows_and_choice(spark):
    x, y = data(240, 3)
    folds = {f: {"train": list(range(f * 40)), "validation": list(range(f * 40, f * 40 + 40))} for f in range(1, 6)}
    rows, roles = frames(spark, x, y, folds)
    settings = [B.Setting(2, 0.0, 20.0), B.Setting(2, 0.3, 2.0, reg_lambda=1.0)]   # the first one never learns
    _, _, experts = training.trained_experts(rows, roles, settings, 2)
    losses = B.setting_losses(experts)
    assert losses[0][0] == settings[1] and losses[1][1] == pytest.approx(np.log(3))
    got = training.out_of_fold(rows, roles, settings, 2).collect()
    assert sorted((r.row_id, r.fold) for r in got) == sorted((i, f) for f, p in folds.items() for i in p["validation"])
    assert all(abs(r.p_down + r.p_flat + r.p_up - 1) < 1e-9 and r.y == y[r.row_id] for r in got)
    with pytest.raises(ValueError):
        training.out_of_fold(rows.withColumn("y", F.lit(1)), roles, settings, 1)


def test_grid_begins_with_the_reference_point_and_is_bounded():
    grid = training.expert_grid()
    assert len(grid) == len(set(grid)) == 20 and grid[0] == B.Setting(2, 0.05, 20.0)
    assert {(s.max_depth, s.learning_rate, s.min_child_weight) for s in grid} > {(2, 0.05, 20.0)}
    assert all(s.max_depth in (2, 3, 4) and 0.03 <= s.learning_rate <= 0.1 and 20 <= s.min_child_weight <= 50 for s in grid)


def test_missing_values_and_constant_features(spark):
    x = np.full((60, 2), np.nan)
    x[:, 1] = 1.0
    rows, roles = frames(spark, x, np.arange(60) % 3, {1: {"train": list(range(40)), "validation": list(range(40, 60))}})
    edges = B.bin_edges(rows)
    e = B.fit_experts(B.prepare(rows, roles, edges), 2, [1], [B.Setting(min_child_weight=0.1)], 2)[0]
    assert np.allclose(B.softmax(e.scores(B.binned(x, edges))).sum(axis=1), 1)
