"""Training rows: purged folds, partitions, pillar matrices, experts and out-of-fold rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import FEATURE_PREFIX
from tidemark.functions.timing import plus_seconds, time_bucket
from tidemark.operators.boosting import Expert, Setting, bin_edges, fit_experts, out_of_fold_scores, prepare, setting_losses
from tidemark.operators.sequence import with_row_index

FOLDS = 5


def fold_starts(clocks: DataFrame) -> list:
    """Start times of the five validation blocks: distinct cutoffs cut at n·i//6.

    Five timestamps reach the driver. Fewer than six distinct cutoffs are refused.
    """
    times = with_row_index(clocks.select("cutoff_at").distinct(), [], [F.col("cutoff_at")],
                           time_bucket("cutoff_at", 86400))
    n = times.count()
    if n < FOLDS + 1:
        raise ValueError("insufficient history: at least six distinct cutoffs are required")
    at = {n * i // (FOLDS + 1) + 1: i for i in range(1, FOLDS + 1)}
    rows = times.where(F.col("idx").isin(*at)).select("idx", F.unix_micros("cutoff_at").alias("us")).collect()
    starts = {at[r["idx"]]: r["us"] for r in rows}
    return [starts[i] for i in range(1, FOLDS + 1)]


def purged_folds(clocks: DataFrame, embargo_s: float = 0.0) -> DataFrame:
    """Rows of (fold, role) with role train or validation; a row without a fold is not listed.

    Training rows end, and are known, strictly before the block start less the embargo.
    Block starts are constants, so this is a map over the rows.
    """
    starts = fold_starts(clocks)
    tags = []
    for i, start in enumerate(starts):
        begin = F.timestamp_micros(F.lit(start))
        limit = plus_seconds(begin, -embargo_s)
        train = (F.col("cutoff_at") < limit) & (F.col("exit_at") < limit) & (F.col("available_at") < limit)
        valid = F.col("cutoff_at") >= begin
        if i + 1 < len(starts):
            valid = valid & (F.col("cutoff_at") < F.timestamp_micros(F.lit(starts[i + 1])))
        tags.append(F.when(train, F.struct(F.lit(i + 1).alias("fold"), F.lit("train").alias("role")))
                    .when(valid, F.struct(F.lit(i + 1).alias("fold"), F.lit("validation").alias("role"))))
    listed = F.filter(F.array(*tags), lambda t: t.isNotNull())
    return clocks.withColumn("_t", F.explode(listed)).select(*clocks.columns, "_t.*")


def excluded_rows(clocks: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows that never fall into a validation block."""
    used = folds.where("role = 'validation'").select("row_id")
    return clocks.join(used, "row_id", "left_anti")


def purge_later(clocks: DataFrame, start: Column, end: Column, maximum_horizon_s: float) -> DataFrame:
    """Rows that end before a validation segment or begin after it plus the longest horizon."""
    return clocks.where((F.col("exit_at") < start) | (F.col("entry_at") > plus_seconds(end, maximum_horizon_s)))


PARTS = ("experts", "fusion", "calibration", "holdout")


def train_partitions(clocks: DataFrame) -> DataFrame:
    """Rows of the 50/20/15/15 split by (cutoff, row) order with `part`; the first three parts are
    purged against the start of the next one. Three timestamps reach the driver."""
    d = with_row_index(clocks, [], [F.col("cutoff_at"), F.col("row_id")], time_bucket("cutoff_at", 86400))
    n = d.count()
    if n < 15:
        raise ValueError("at least 15 rows are required")
    sizes = [int(n * 0.50), int(n * 0.20), int(n * 0.15)]
    ends = [sum(sizes[:i + 1]) for i in range(3)]
    got = d.where(F.col("idx").isin(*[e + 1 for e in ends])).select("idx", F.unix_micros("cutoff_at").alias("us")).collect()
    next_start = {r["idx"] - 1: r["us"] for r in got}
    part = F.lit(PARTS[3])
    limit = F.lit(None).cast("timestamp")
    for name, e in reversed(list(zip(PARTS, ends))):
        part = F.when(F.col("idx") <= e, F.lit(name)).otherwise(part)
        limit = F.when(F.col("idx") <= e, F.timestamp_micros(F.lit(next_start[e]))).otherwise(limit)
    d = d.withColumn("part", part).withColumn("_limit", limit)
    return d.where(F.col("_limit").isNull()
                   | ((F.col("exit_at") < F.col("_limit")) & (F.col("available_at") < F.col("_limit")))) \
            .drop("_limit", "idx")


def pillar_matrix(snapshots: DataFrame, pillar: str, names: list[str] | None = None) -> DataFrame:
    """Feature columns of one pillar in fixed (sorted) order as array<double>; missing is NaN."""
    prefix = FEATURE_PREFIX[pillar]
    names = names or sorted(c for c in snapshots.columns if c.startswith(prefix)
                            and dict(snapshots.dtypes)[c] == "double")
    nan = F.lit(float("nan"))
    return snapshots.withColumn("features", F.array(*[F.coalesce(F.col(n).cast("double"), nan) for n in names]))


def common_rows(predictions: DataFrame, pillars: list[str]) -> DataFrame:
    """Decision rows present in the output of every pillar, one wide row each.

    The aggregate counts pillars and pivots in one shuffle.
    """
    cols = [F.max(F.when(F.col("pillar") == p, F.col(f"p_{k}"))).alias(f"{p}_{k}")
            for p in pillars for k in ("down", "flat", "up")]
    return (predictions.where(F.col("pillar").isin(*pillars)).groupBy("row_id")
            .agg(F.countDistinct("pillar").alias("_n"), F.max("y").alias("y"), *cols)
            .where(F.col("_n") == len(pillars)).drop("_n"))


def missing_classes(rows: DataFrame, by: list[str]) -> DataFrame:
    """Groups whose training rows lack one of the three classes."""
    return rows.groupBy(*by).agg(F.countDistinct("y").alias("classes")).where("classes < 3")


EXPERT_DEPTHS, EXPERT_RATES, EXPERT_CHILD_WEIGHTS = (2, 3, 4), (0.03, 0.05, 0.08, 0.10), (20.0, 30.0, 50.0)   # fixed values: the bounds of the search


def expert_grid(count: int = 20) -> list[Setting]:
    """Bounded settings: the reference point (depth 2) first, then a walk that mixes the allowed values."""
    grid = [Setting(max_depth=2, learning_rate=0.05, min_child_weight=20.0)]
    for i in range(count - 1):
        grid.append(Setting(EXPERT_DEPTHS[i % 3], EXPERT_RATES[(i + i // 3) % 4], EXPERT_CHILD_WEIGHTS[(i // 2) % 3], seed=43 + i))
    return grid


def trained_experts(rows: DataFrame, folds: DataFrame, settings: list[Setting], rounds: int, folds_used: list[int] | None = None) -> tuple[DataFrame, int, list[Expert]]:
    """(binned rows, features, experts of every fold and setting) from rows (row_id, features, y) and folds (row_id, fold, role).

    Each training set must hold all three classes.
    """
    tagged = rows.select("row_id", "y").join(folds, "row_id")
    lacking = missing_classes(tagged.where("role = 'train'"), ["fold"]).collect()   # at most one row per fold
    if lacking:
        raise ValueError(f"folds {sorted(r['fold'] for r in lacking)}: all three outcome classes are required")
    edges = bin_edges(rows)
    table = prepare(rows, folds, edges)
    return table, len(edges), fit_experts(table, len(edges), folds_used or list(range(1, FOLDS + 1)), settings, rounds)


def out_of_fold(rows: DataFrame, folds: DataFrame, settings: list[Setting] | None = None, rounds: int = 50) -> DataFrame:
    """Train every setting on each fold's training rows, choose the setting of least mean validation loss and predict all validation rows with it."""
    table, width, experts = trained_experts(rows, folds, settings or expert_grid(1), rounds)
    chosen = setting_losses(experts)[0][0]
    return out_of_fold_scores(table, [e for e in experts if e.setting == chosen], width)
