"""Calibration metrics and parameter fits as grid aggregates. No row leaves the executors."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import floored_ln, softmax
from tidemark.functions.timing import col
from tidemark.session import cut_lineage

# fixed values: bin edges i/10 as the nearest doubles of a linear spacing
EDGES = tuple(i * 0.1 for i in range(10))


def confidence_bin(confidence: Column) -> Column:
    """Bin by comparison with the edges; the last bin includes 1."""
    out = F.lit(0)
    for i, edge in enumerate(EDGES[1:], start=1):
        out = F.when(confidence >= F.lit(edge), F.lit(i)).otherwise(out)
    return out


def argmax_class(p_down: Column, p_flat: Column, p_up: Column) -> Column:
    """Index of the largest probability; ties go to the lowest class."""
    top = F.greatest(p_down, p_flat, p_up)
    return F.when(p_down == top, 0).when(p_flat == top, 1).otherwise(2)


def calibration_report(rows: DataFrame, by: list[str] | None = None,
                       probs: tuple[str, str, str] = ("p_down", "p_flat", "p_up"), y: str = "y") -> DataFrame:
    """ece, max_error, brier, mean_confidence, accuracy and n; zeros for an empty input.

    Two aggregates: ten partial rows per task, then ten rows per group.
    """
    by = by or []
    d, f, u = (F.col(p) for p in probs)
    conf = F.greatest(d, f, u)
    hit = (argmax_class(d, f, u) == col(y)).cast("double")
    sq = sum([F.pow(p - F.when(col(y) == k, 1.0).otherwise(0.0), F.lit(2)) for k, p in enumerate((f, u), 1)],
             F.pow(d - F.when(col(y) == 0, 1.0).otherwise(0.0), F.lit(2)))
    bins = rows.groupBy(*by, confidence_bin(conf).alias("_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(conf).alias("_conf"), F.sum(hit).alias("_hit"), F.sum(sq).alias("_sq"))
    gap = F.abs(F.col("_hit") - F.col("_conf"))
    n = F.sum("n")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return bins.groupBy(*by).agg(
        zero(F.sum(gap) / n).alias("ece"), zero(F.max(gap / F.col("n"))).alias("max_error"),
        zero(F.sum("_sq") / n).alias("brier"), zero(F.sum("_conf") / n).alias("mean_confidence"),
        zero(F.sum("_hit") / n).alias("accuracy"), F.coalesce(n, F.lit(0)).alias("n"))


def true_class_nll(probs: list[Column], y: Column) -> Column:
    p = F.when(y == 0, probs[0]).when(y == 1, probs[1]).otherwise(probs[2])
    return -floored_ln(p, 1e-12)


def temperature_curve(logits: DataFrame, grid: list[float], z: tuple[str, str, str] = ("z_down", "z_flat", "z_up"),
                      y: str = "y") -> DataFrame:
    """Mean negative log likelihood per temperature: the grid rides along with each row and one
    map-side aggregate leaves len(grid) rows per task."""
    t = F.col("temperature")
    d = logits.select(*z, y).withColumn("temperature", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    nll = true_class_nll(softmax([F.col(c) / t for c in z]), F.col(y))
    return d.groupBy("temperature").agg(F.avg(nll).alias("nll"), F.count(F.lit(1)).alias("n"))


TEMPERATURE_LOW, TEMPERATURE_HIGH = 0.1, 10.0


def fit_temperatures(rows: DataFrame, cohort: str, points: int = 21, passes: int = 3) -> DataFrame:
    """(cohort, temperature) of least mean negative log-likelihood on rows (cohort, z_down, z_flat, z_up, y), all cohorts in the same passes.

    A pass tries `points` temperatures evenly spaced in ratio between the bounds of each cohort, one aggregate for all rows; the next pass lies between the
    neighbours of the best one. The bounds are a joined row per cohort. Fewer than five rows give 1.0.
    """
    n = rows.groupBy(cohort).agg(F.count(F.lit(1)).alias("_n"))
    at = cut_lineage(n.select(cohort, "_n", F.lit(TEMPERATURE_LOW).alias("_low"), F.lit(TEMPERATURE_HIGH).alias("_high")))
    for _ in range(passes):
        step = F.pow(F.col("_high") / F.col("_low"), F.lit(1.0 / (points - 1)))
        d = rows.join(at, cohort).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("_t", F.col("_low") * F.pow(step, F.col("_i")))
        nll = true_class_nll(softmax([F.col(c) / F.col("_t") for c in ("z_down", "z_flat", "z_up")]), F.col("y"))
        curve = d.groupBy(cohort, "_n", "_low", "_high", "_i").agg(F.round(F.avg(nll), 12).alias("_nll"))
        best = curve.groupBy(cohort, "_n", "_low", "_high").agg(F.min_by("_i", F.struct("_nll", "_i")).alias("_i"))
        near = lambda k: F.col("_low") * F.pow(step, F.greatest(F.lit(0), F.least(F.lit(points - 1), F.col("_i") + k)))
        at = cut_lineage(best.select(cohort, "_n", near(-1).alias("_next_low"), near(1).alias("_next_high"), near(0).alias("_best"))
                         .select(cohort, "_n", F.col("_next_low").alias("_low"), F.col("_next_high").alias("_high"), "_best"))
    return at.select(cohort, F.when(F.col("_n") < 5, 1.0).otherwise(F.col("_best")).alias("temperature"))


def fit_pool_weights(rows: DataFrame, baseline: DataFrame, cohort: str, pillars: list[str], steps: int = 5, passes: int = 3) -> DataFrame:
    """(cohort, w_<pillar>…, fitted) of least loss on rows (cohort, ln_<pillar>_<class>…, y), all cohorts in the same passes.

    loss = mean negative log-likelihood of the pool + ½·‖w − baseline‖². A pass tries a lattice around each cohort's centre, a joined row: every pillar but the last moves by
    fractions of its baseline b, the last takes the remainder, all stay in [0.5·b, 1.5·b]. The step halves from pass to pass. `baseline` has b_<pillar> per cohort; a
    cohort without rows keeps it, unfitted.
    """
    free, last = pillars[:-1], pillars[-1]
    offsets = list(product(*[[2 * i / (steps - 1) - 1 for i in range(steps)]] * len(free)))
    lattice = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(float(x)).alias(p) for p, x in zip(free, o, strict=True)]) for i, o in enumerate(offsets)])
    at = cut_lineage(baseline.select(cohort, *[f"b_{p}" for p in pillars], *[F.col(f"b_{p}").alias(f"c_{p}") for p in pillars], F.lit(False).alias("fitted")))
    for k in range(passes):
        span = 0.5 / (1 << k)
        w = {p: F.col(f"c_{p}") + F.col(f"b_{p}") * span * F.col(f"_c.{p}") for p in free}
        w[last] = F.lit(1.0) - sum([w[p] for p in free[1:]], w[free[0]])
        inside = F.lit(True)
        for p in pillars:
            inside = inside & w[p].between(F.col(f"b_{p}") * 0.5 - 1e-12, F.col(f"b_{p}") * 1.5 + 1e-12)
        tried = at.withColumn("_c", F.explode(lattice)).where(inside).select(
            cohort, F.col("_c.i").alias("_i"), *[w[p].alias(f"w_{p}") for p in pillars], *[f"b_{p}" for p in pillars])
        per = tried.groupBy(cohort).agg(F.array_sort(F.collect_list(F.struct("_i", *[f"w_{p}" for p in pillars]))).alias("_w"))   # the lattice of a cohort, a fixed size
        d = rows.join(per, cohort).withColumn("_w", F.explode("_w")).select(*rows.columns, "_w.*")
        z = [sum([F.col(f"w_{p}") * F.col(f"ln_{p}_{c}") for p in pillars[1:]], F.col(f"w_{pillars[0]}") * F.col(f"ln_{pillars[0]}_{c}")) for c in ("down", "flat", "up")]
        scored = d.groupBy(cohort, "_i").agg(F.avg(true_class_nll(softmax(z), F.col("y"))).alias("_nll")).join(tried, [cohort, "_i"])
        away = [F.pow(F.col(f"w_{p}") - F.col(f"b_{p}"), F.lit(2)) for p in pillars]
        scored = scored.withColumn("_loss", F.round(F.col("_nll") + 0.5 * sum(away[1:], away[0]), 12))
        best = scored.groupBy(cohort).agg(F.min_by(F.struct(*[f"w_{p}" for p in pillars]), F.struct("_loss", "_i")).alias("_b"))
        at = cut_lineage(at.join(best, cohort, "left").select(
            cohort, *[f"b_{p}" for p in pillars], *[F.coalesce(F.col(f"_b.w_{p}"), F.col(f"c_{p}")).alias(f"c_{p}") for p in pillars],
            (F.col("fitted") | F.col("_b").isNotNull()).alias("fitted")))
    return at.select(cohort, *[F.col(f"c_{p}").alias(f"w_{p}") for p in pillars], "fitted")


def pooled_logits(rows: DataFrame, weights: DataFrame, cohort: str, pillars: list[str]) -> DataFrame:
    """Rows with z_down, z_flat, z_up of the weighted log pool."""
    d = rows.join(weights, cohort)
    z = {c: sum([F.col(f"w_{p}") * F.col(f"ln_{p}_{c}") for p in pillars[1:]], F.col(f"w_{pillars[0]}") * F.col(f"ln_{pillars[0]}_{c}")) for c in ("down", "flat", "up")}
    return d.select(*rows.columns, *[v.alias(f"z_{c}") for c, v in z.items()])


def gate_on_holdout(rows: DataFrame, baseline: DataFrame, cohort: str, pillars: list[str], ece_gate: float) -> DataFrame:
    """Weights from the rows of part `fusion`, temperature from `calibration`, calibration report and verdict from `holdout`, per cohort.

    rows(cohort, part, y, ln_<pillar>_<class>…). A cohort without held-out rows does not pass.
    """
    part = lambda name: rows.where(F.col("part") == name)
    weights = fit_pool_weights(part("fusion"), baseline, cohort, pillars)
    heat = fit_temperatures(pooled_logits(part("calibration"), weights, cohort, pillars), cohort)
    fitted = cut_lineage(weights.join(heat, cohort, "left").withColumn("temperature", F.coalesce("temperature", F.lit(1.0))))
    held = pooled_logits(part("holdout"), fitted, cohort, pillars).join(fitted.select(cohort, "temperature"), cohort)
    p = softmax([F.col(f"z_{c}") / F.col("temperature") for c in ("down", "flat", "up")])
    report = calibration_report(held.select(cohort, "y", *[x.alias(f"p_{c}") for x, c in zip(p, ("down", "flat", "up"), strict=True)]), [cohort])
    return fitted.join(report, cohort, "left").withColumn("passed", F.coalesce(F.col("ece") <= ece_gate, F.lit(False)))


def weight_lattice(baseline: dict[str, float], steps: int = 5, center: dict[str, float] | None = None,
                   span: float = 0.5) -> list[tuple[float, ...]]:
    """Weight vectors around `center` that sum to 1 and stay in [0.5·b, 1.5·b]. The last pillar
    takes the remainder."""
    names = list(baseline)
    c = center or baseline
    axes = [[c[p] + baseline[p] * span * (2 * i / (steps - 1) - 1) for i in range(steps)] for p in names[:-1]]
    out = []
    for point in product(*axes):
        w = (*point, 1.0 - sum(point))
        if all(0.5 * b - 1e-12 <= x <= 1.5 * b + 1e-12 for x, b in zip(w, baseline.values())):
            out.append(w)
    return out


def fusion_loss(rows: DataFrame, baseline: dict[str, float], candidates: list[tuple[float, ...]]) -> DataFrame:
    """Loss per candidate weight vector on rows with ln_<pillar>_<class> columns and y.

    loss = mean NLL of the pool + ½·‖w − baseline‖². Candidates ride along with each row.
    """
    names = list(baseline)
    cand = F.array(*[F.struct(F.lit(i).alias("candidate"), *[F.lit(float(w)).alias(f"w_{p}") for p, w in zip(names, ws)])
                     for i, ws in enumerate(candidates)])
    d = rows.withColumn("_c", F.explode(cand)).select("*", "_c.*")
    z = []
    for k in ("down", "flat", "up"):
        terms = [F.col(f"w_{p}") * F.col(f"ln_{p}_{k}") for p in names]
        z.append(sum(terms[1:], terms[0]))
    dist = [F.pow(F.col(f"w_{p}") - F.lit(baseline[p]), F.lit(2)) for p in names]
    penalty = 0.5 * sum(dist[1:], dist[0])
    cols = [f"w_{p}" for p in names]
    return (d.groupBy("candidate", *cols).agg(F.avg(true_class_nll(softmax(z), F.col("y"))).alias("nll"))
            .withColumn("loss", F.col("nll") + penalty))


def wide_log_probs(predictions: DataFrame, pillars: list[str], key: list[str]) -> DataFrame:
    """One row per decision with ln_<pillar>_<class> columns."""
    return predictions.groupBy(*key).agg(*[
        F.max(F.when(F.col("pillar") == p, floored_ln(F.col(f"p_{k}")))).alias(f"ln_{p}_{k}")
        for p in pillars for k in ("down", "flat", "up")])
