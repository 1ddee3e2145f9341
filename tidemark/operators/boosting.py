"""Multinomial boosted trees by gradient histograms, all folds and settings at once.

The rows are binned once. A pass scores them with the trees so far, adds up gradients per (model, class, node, feature, bin) inside each task, and one aggregate sums
the tasks' histograms; split points are chosen from the sums by columns, so a level of every tree of every fold and setting costs one job. Only the chosen splits
reach the driver: at most models × classes × nodes of a level. Trees are small and travel with the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, spread

CLASSES = 3
BINS = 32
MISSING = BINS   #: the bin of missing values; each split learns their side


@dataclass(frozen=True)
class Setting:
    max_depth: int = 2
    learning_rate: float = 0.05
    min_child_weight: float = 20.0
    subsample: float = 0.8
    colsample: float = 0.8
    reg_lambda: float = 10.0
    seed: int = 42


class Tree:
    """Nodes in heap order: children of n are 2n + 1 and 2n + 2."""

    def __init__(self, depth: int):
        n = (2 << depth) - 1
        self.feature, self.cut = np.full(n, -1), np.zeros(n, np.int64)
        self.left_if_missing, self.value = np.zeros(n, bool), np.zeros(n)

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of every row after so many steps; a row stays where there is no split."""
        at = np.zeros(len(bins), np.int64)
        for _ in range(levels):
            feature = self.feature[at]
            b = bins[np.arange(len(bins)), np.maximum(feature, 0)]
            right = np.where(b == MISSING, ~self.left_if_missing[at], b > self.cut[at])
            at = np.where(feature < 0, at, 2 * at + 1 + right)
        return at


@dataclass
class Expert:
    """The trees of one (fold, setting): a list of rounds, each with one tree per class."""

    fold: int
    setting: Setting
    rounds: list[list[Tree]]
    losses: list[float]   #: validation loss before each round and after the last one
    best: int = 0         #: rounds of least validation loss

    def scores(self, bins: np.ndarray, rounds: int | None = None) -> np.ndarray:
        out = np.zeros((len(bins), CLASSES))
        for trees in self.rounds[:rounds]:
            for k, tree in enumerate(trees):
                out[:, k] += tree.value[tree.nodes(bins, self.setting.max_depth)]
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Even hash of row numbers in [0, 1)."""
    x = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)


def sampled_rows(row: np.ndarray, setting: Setting, round_: int) -> np.ndarray:
    return _mixed(row, setting.seed * 1000003 + round_) < setting.subsample


def sampled_features(n: int, setting: Setting, round_: int) -> np.ndarray:
    """The features of a round, the share of the setting, at least one."""
    order = np.argsort(_mixed(np.arange(n), setting.seed * 7919 + round_ + 500_000_009), kind="stable")
    return np.sort(order[:max(1, round(setting.colsample * n))])


def bin_edges(rows: DataFrame, features: str = "features", bins: int = BINS) -> np.ndarray:
    """Quantiles of every feature (features, bins - 1); missing values do not count. One aggregate over (feature) rows."""
    shares = [i / bins for i in range(1, bins)]
    d = rows.select(F.posexplode(features).alias("f", "x")).where(~F.isnan("x") & F.col("x").isNotNull())
    got = {r["f"]: r["q"] for r in d.groupBy("f").agg(F.percentile_approx("x", F.array(*map(F.lit, shares)), 10_000).alias("q")).collect()}
    size = rows.agg(F.max(F.size(features)).alias("n")).first()["n"] or 0
    return np.array([got.get(f, [np.inf] * (bins - 1)) for f in range(size)])


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin of every value: the number of edges below it."""
    out = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) if len(edges) else np.zeros((len(x), 0))
    return np.where(np.isnan(x), MISSING, out).astype(np.uint8)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return np.asarray(flat.to_numpy(zero_copy_only=False), float).reshape(-1, width)


def prepare(rows: DataFrame, roles: DataFrame, edges: np.ndarray) -> DataFrame:
    """(row_id, y, bins, train, valid): bits of `train` and `valid` name the folds in which a row has that role. Written once."""
    bits = lambda role: F.coalesce(F.bit_or(F.when(F.col("role") == role, F.pow(F.lit(2), F.col("fold")).cast("bigint"))), F.lit(0))
    per_row = roles.groupBy("row_id").agg(bits("train").cast("bigint").alias("train"), bits("validation").cast("bigint").alias("valid"))
    d = spread(rows.join(per_row, "row_id"))
    width = len(edges)

    @F.arrow_udf("binary")
    def as_bins(features: pa.Array) -> pa.Array:
        return pa.array([b.tobytes() for b in binned(_matrix(features, width), edges)], pa.binary())

    return cut_lineage(d.select("row_id", F.col("y").cast("int").alias("y"), as_bins("features").alias("bins"), "train", "valid"))


def _unpacked(b: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(-1, width)


HIST = "model int, class int, node int, feature int, bin int, g double, h double"


def histograms(table: DataFrame, experts: list[Expert], level: int, width: int) -> DataFrame:
    """Sums of gradients and curvatures per (model, class, node, feature, bin) of the last round's trees. On level 0 rows with class −1 carry the
    validation loss: g is its sum, h the number of rows."""
    names = [c.split()[0] for c in HIST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        loss = np.zeros((len(experts), 2))
        slots = BINS + 1
        for b in batches:
            bins, y, row = _unpacked(b, width), b.column("y").to_numpy(), b.column("row_id").to_numpy()
            train, valid = b.column("train").to_numpy(), b.column("valid").to_numpy()
            for m, e in enumerate(experts):
                round_ = len(e.rounds) - 1
                mine, checks = train >> e.fold & 1 == 1, valid >> e.fold & 1 == 1
                if level == 0 and checks.any():
                    p = softmax(e.scores(bins[checks], round_))
                    loss[m] += -np.log(np.maximum(p[np.arange(len(p)), y[checks]], 1e-15)).sum(), len(p)
                mine &= sampled_rows(row, e.setting, round_)
                if level >= e.setting.max_depth or not mine.any():
                    continue
                x, target = bins[mine], y[mine]
                p = softmax(e.scores(x, round_))
                for k, tree in enumerate(e.rounds[round_]):
                    at = tree.nodes(x, level) - ((1 << level) - 1)
                    open_ = at >= 0
                    g, h = p[:, k] - (target == k), np.maximum(2 * p[:, k] * (1 - p[:, k]), 1e-16)
                    total = sums.setdefault((m, k), np.zeros((2, width, (1 << level) * slots)))
                    for f in sampled_features(width, e.setting, round_):
                        place = at[open_] * slots + x[open_, f]
                        total[0, f] += np.bincount(place, weights=g[open_], minlength=total.shape[2])
                        total[1, f] += np.bincount(place, weights=h[open_], minlength=total.shape[2])
        for (m, k), total in sums.items():
            feature, place = np.nonzero(total[1])
            n = len(feature)
            yield pa.record_batch([pa.array(np.full(n, m, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array((place // slots).astype(np.int32)), pa.array(feature.astype(np.int32)),
                                   pa.array((place % slots).astype(np.int32)), pa.array(total[0][feature, place]), pa.array(total[1][feature, place])], names=names)
        some = np.flatnonzero(loss[:, 1])
        fill = [pa.array(np.full(len(some), v, np.int32)) for v in (-1, 0, 0, 0)]
        yield pa.record_batch([pa.array(some.astype(np.int32)), *fill, pa.array(loss[some, 0]), pa.array(loss[some, 1])], names=names)

    return table.select("row_id", "y", "bins", "train", "valid").mapInArrow(run, HIST).groupBy("model", "class", "node", "feature", "bin").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h"))


def best_splits(sums: DataFrame, settings: DataFrame) -> DataFrame:
    """Per (model, class, node): sums of the node and its best split, NULL where none gains. `settings` has reg_lambda and min_child_weight per model."""
    by = ["model", "class", "node", "feature"]
    every = Window.partitionBy(*by)
    upto = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    d = sums.join(F.broadcast(settings), "model")   # one row per model
    gone = F.col("bin") == MISSING
    d = d.select("*", *[F.sum(c).over(every).alias(f"{c}_all") for c in "gh"], *[F.coalesce(F.sum(F.when(gone, F.col(c))).over(every), F.lit(0.0)).alias(f"{c}_gone") for c in "gh"],
                 *[F.sum(F.when(~gone, F.col(c))).over(upto).alias(f"{c}_low") for c in "gh"])
    d = d.withColumn("left_if_missing", F.explode(F.array(F.lit(True), F.lit(False))))
    low = {c: F.col(f"{c}_low") + F.when(F.col("left_if_missing"), F.col(f"{c}_gone")).otherwise(0.0) for c in "gh"}
    high = {c: F.col(f"{c}_all") - low[c] for c in "gh"}
    worth = lambda s: s["g"] * s["g"] / (s["h"] + F.col("reg_lambda"))
    whole = {c: F.col(f"{c}_all") for c in "gh"}
    fair = ~gone & (low["h"] >= F.col("min_child_weight")) & (high["h"] >= F.col("min_child_weight"))
    d = d.withColumn("gain", F.when(fair, F.round(worth(low) + worth(high) - worth(whole), 9)))
    order = F.when(F.col("gain") > 0, F.struct("gain", -F.col("feature"), -F.col("bin"), "left_if_missing"))
    return d.groupBy("model", "class", "node").agg(F.max_by(F.struct("feature", "bin", "left_if_missing"), order).alias("split"),
                                                   F.max_by("g_all", -F.col("feature")).alias("g"), F.max_by("h_all", -F.col("feature")).alias("h"),
                                                   F.max_by(F.struct(low["g"].alias("lg"), low["h"].alias("lh"), high["g"].alias("rg"), high["h"].alias("rh")), order).alias("parts"))


def fit_experts(table: DataFrame, width: int, folds: list[int], settings: list[Setting], rounds: int, patience: int = 20) -> list[Expert]:
    """Experts of every fold and setting. Early stopping keeps the rounds of least validation loss, looking `patience` rounds ahead."""
    spark = table.sparkSession
    experts = [Expert(f, s, [], []) for f in folds for s in settings]
    side = spark.createDataFrame([(m, float(e.setting.reg_lambda), float(e.setting.min_child_weight)) for m, e in enumerate(experts)],
                                 "model int, reg_lambda double, min_child_weight double")
    for _ in range(rounds + 1):
        for e in experts:
            e.rounds.append([Tree(e.setting.max_depth) for _ in range(CLASSES)])
        last = len(experts[0].rounds) == rounds + 1
        for level in range(1 if last else max(s.max_depth for s in settings)):
            sums = histograms(table, experts, level, width)
            if level == 0:
                sums = cut_lineage(sums)
                for r in sums.where("class = -1").collect():   # one row per model
                    experts[r["model"]].losses.append(r["g"] / r["h"])
            if not last:
                for r in best_splits(sums.where("class >= 0"), side).collect():   # at most models × classes × nodes of the level
                    _grow(experts[r["model"]], r, level)
        if last or all(len(e.losses) > patience and min(e.losses[-patience:]) >= min(e.losses[:-patience]) for e in experts):
            break
    for e in experts:
        e.rounds.pop()
        e.best = int(np.argmin(e.losses)) if e.losses else len(e.rounds)
    return experts


def _grow(e: Expert, r, level: int) -> None:
    tree, node, s = e.rounds[-1][r["class"]], (1 << level) - 1 + r["node"], e.setting
    tree.value[node] = -s.learning_rate * r["g"] / (r["h"] + s.reg_lambda)
    if r["split"] is not None:
        tree.feature[node], tree.cut[node], tree.left_if_missing[node] = r["split"]["feature"], r["split"]["bin"], r["split"]["left_if_missing"]
        for child, g, h in ((2 * node + 1, r["parts"]["lg"], r["parts"]["lh"]), (2 * node + 2, r["parts"]["rg"], r["parts"]["rh"])):
            tree.value[child] = -s.learning_rate * g / (h + s.reg_lambda)


def setting_losses(experts: list[Expert]) -> list[tuple[Setting, float]]:
    """Mean over the folds of each setting's least validation loss, best first; ties keep the order of the grid."""
    settings = list(dict.fromkeys(e.setting for e in experts))
    mean = lambda s: float(np.mean([min(e.losses) for e in experts if e.setting == s and e.losses] or [np.inf]))
    return sorted(((s, mean(s)) for s in settings), key=lambda x: x[1])


def out_of_fold_scores(table: DataFrame, experts: list[Expert], width: int) -> DataFrame:
    """Class probabilities of each validation row by the expert of its fold, renormalised to sum to one; (row_id, y, fold, p_down, p_flat, p_up)."""
    names = ["row_id", "y", "fold", "p_down", "p_flat", "p_up"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins, valid = _unpacked(b, width), b.column("valid").to_numpy()
            for e in experts:
                mine = np.flatnonzero(valid >> e.fold & 1 == 1)
                if len(mine):
                    p = softmax(e.scores(bins[mine], e.best))
                    yield pa.record_batch([pa.array(b.column(c).to_numpy()[mine]) for c in ("row_id", "y")] + [pa.array(np.full(len(mine), e.fold, np.int32))]
                                          + [pa.array(p[:, k]) for k in range(CLASSES)], names=names)

    return table.select("row_id", "y", "bins", "valid").mapInArrow(run, "row_id bigint, y int, fold int, p_down double, p_flat double, p_up double")
