"""Training and calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.constants import ECE_GATE, PILLARS, PRIORS
from tidemark.functions.checks import clock_problems, violations
from tidemark.functions.policy import class_index
from tidemark.operators import calibration as C
from tidemark.operators import fusion, training
from tidemark.operators.reference import asof_macro
from tidemark.plans.catalog_policy import KEY, outcomes
from tidemark.plans.registry import plain, query
from tidemark.session import cut_lineage
from tidemark.sources import testtables as tt

GRID = [0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0, 6.0, 8.0]


@query
def target_clock_checks(spark, sf):
    """Clocks with some rows spoilt by rule."""
    d = tt.target_clocks(spark, sf)
    i = F.col("row_id")
    minute = F.expr("INTERVAL 1 MINUTE")
    d = (d.withColumn("entry_at", F.when(i % 7 == 0, F.col("cutoff_at") - minute).otherwise(F.col("entry_at")))
         .withColumn("exit_at", F.when(i % 11 == 0, F.col("entry_at")).otherwise(F.col("exit_at")))
         .withColumn("available_at", F.when(i % 13 == 0, F.col("exit_at") - minute).otherwise(F.col("available_at"))))
    frozen = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return plain(d.select("row_id", F.array_join(violations(clock_problems(frozen)), ",").alias("violations")))


@query
def purged_folds(spark, sf):
    return plain(training.purged_folds(tt.target_clocks(spark, sf), 3600.0).select("row_id", "fold", "role"))


@query
def oof_excluded(spark, sf):
    c = tt.target_clocks(spark, sf)
    return plain(training.excluded_rows(c, training.purged_folds(c)).select("row_id"))


@query
def purge_later(spark, sf):
    start, end = (F.lit(f"2024-01-{d} 00:00:00").cast("timestamp") for d in ("05", "09"))
    return plain(training.purge_later(tt.target_clocks(spark, sf), start, end, 86400.0).select("row_id"))


@query
def train_partitions(spark, sf):
    return plain(training.train_partitions(tt.target_clocks(spark, sf)).select("row_id", "part"))


def partial_predictions(spark, sf):
    """Predictions with some rows missing per pillar, as out-of-fold outputs have."""
    p = tt.pillar_predictions(spark, sf)
    n = F.when(F.col("pillar") == "technical", 5).when(F.col("pillar") == "macro", 6) \
        .when(F.col("pillar") == "etf", 7).otherwise(8)
    return p.where(F.col("row_id") % n != 0)


@query
def fusion_rows(spark, sf):
    return plain(training.common_rows(partial_predictions(spark, sf), list(PILLARS)))


@query
def oof_set_ops(spark, sf):
    p = partial_predictions(spark, sf)
    a, b = (p.where(F.col("pillar") == x).select("row_id") for x in ("technical", "macro"))
    both = a.intersect(b).withColumn("kind", F.lit("common"))
    only = a.exceptAll(b).withColumn("kind", F.lit("technical only"))
    return plain(both.unionByName(only))


@query
def pillar_dataset(spark, sf):
    """Macro feature vectors with the realised class of every decision that has one."""
    d = tt.decisions(spark, sf)
    m = asof_macro(d.select("cutoff_at").distinct(), tt.macro_observations(spark, sf)).select(
        "cutoff_at", F.col("cpi.value").alias("macro_cpi_level"), F.col("cpi.mom_pct").alias("macro_cpi_mom_pct"),
        F.col("effr.value").alias("macro_effr_rate"))
    y = outcomes(spark, sf).where("outcome IS NOT NULL").select(*KEY, class_index(F.col("outcome")).alias("y"))
    x = training.pillar_matrix(d.join(m, "cutoff_at").join(y, KEY), "macro")
    return plain(x.select(*KEY, "y", *[F.col("features")[i].alias(f"f{i}") for i in range(3)]))


@query
def calibration_ece(spark, sf):
    p = tt.pillar_predictions(spark, sf)
    by = C.calibration_report(p, ["pillar"])
    return plain(by.unionByName(C.calibration_report(p).withColumn("pillar", F.lit("all"))))


@query
def temperature_grid(spark, sf):
    z = tt.read(spark, sf, "embeddings").select(
        *[(F.col("embedding")[i].cast("double") * 5).alias(n) for i, n in enumerate(("z_down", "z_flat", "z_up"))],
        (F.col("label") % 3).alias("y"))
    return plain(C.temperature_curve(z, GRID))


@query
def fusion_weight_grid(spark, sf):
    rows = C.wide_log_probs(tt.pillar_predictions(spark, sf), list(PILLARS), ["row_id", "y"])
    base = PRIORS["swing_24h"]
    return plain(C.fusion_loss(rows, base, C.weight_lattice(base, 3)).drop("candidate"))


@query
def calibration_gate(spark, sf):
    """ECE of the pooled probabilities per training part and horizon, against the gate."""
    parts = training.train_partitions(tt.target_clocks(spark, sf)).select("row_id", "part", "y")
    p = (tt.pillar_predictions(spark, sf).drop("y").withColumn("horizon", F.expr(tt.horizon_of("row_id")))
         .withColumn("mode", F.lit("FULL")).withColumn("quality", F.lit(1.0)))
    w = fusion.baseline_weights(spark).withColumnRenamed("baseline", "weight")
    f = fusion.fuse(p, w, ["row_id", "horizon"]).join(parts, "row_id")
    rep = C.calibration_report(f, ["part", "horizon"], ("fused_down", "fused_flat", "fused_up"))
    return plain(rep.withColumn("passed", F.col("ece") <= ECE_GATE))


def parts_and_horizons(spark, sf):
    return training.train_partitions(tt.target_clocks(spark, sf)).select("row_id", "part").withColumn("horizon", F.expr(tt.horizon_of("row_id")))


def prior_rows(spark):
    return spark.createDataFrame([(h, *w.values()) for h, w in PRIORS.items()], "horizon string, " + ", ".join(f"b_{p} double" for p in next(iter(PRIORS.values()))))


@query
def fitted_gate(spark, sf):
    """Pool weights, temperature and held-out calibration per horizon, fitted on separate parts of the rows."""
    rows = C.wide_log_probs(tt.pillar_predictions(spark, sf), list(PILLARS), ["row_id", "y"]).join(parts_and_horizons(spark, sf), "row_id")
    return plain(C.gate_on_holdout(rows, prior_rows(spark), "horizon", list(PILLARS), ECE_GATE))


@query
def training_pipeline(spark, sf):
    """Experts of four pillars, their pool, its temperature and the gate: each fitted on its own part of the rows. The pillars take a quarter of the embedding each."""
    parts = cut_lineage(parts_and_horizons(spark, sf))
    e = tt.read(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") % 3).cast("int").alias("y"), F.transform("embedding", lambda x: x.cast("double")).alias("_e"))
    roles = parts.select("row_id", F.lit(1).alias("fold"), F.when(F.col("part") == "experts", "train").otherwise("validation").alias("role"))
    scored = []
    for i, p in enumerate(PILLARS):
        rows = e.select("row_id", "y", F.slice("_e", 16 * i + 1, 16).alias("features"))
        table, width, experts = training.trained_experts(rows, roles, training.expert_grid(1), rounds=3, folds_used=[1])
        scored.append(training.out_of_fold_scores(table, experts, width).withColumn("pillar", F.lit(p)))
    every = scored[0].unionByName(scored[1]).unionByName(scored[2]).unionByName(scored[3])
    rows = C.wide_log_probs(every, list(PILLARS), ["row_id", "y"]).join(parts, "row_id")
    return plain(C.gate_on_holdout(rows, prior_rows(spark), "horizon", list(PILLARS), ECE_GATE))


def expert_rows(spark, sf):
    """Embedding features with a class, and the purged folds of the same row numbers."""
    e = tt.read(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") % 3).cast("int").alias("y"),
                                                F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    return e, training.purged_folds(tt.target_clocks(spark, sf)).select("row_id", "fold", "role")


@query
def oof_predictions(spark, sf):
    """Out-of-fold class probabilities of boosted trees, the setting chosen by validation loss."""
    return plain(training.out_of_fold(*expert_rows(spark, sf), training.expert_grid(2), rounds=4))


@query
def oof_rows(spark, sf):
    """Which expert's fold predicts which row, and that its probabilities are proper."""
    p = training.out_of_fold(*expert_rows(spark, sf), training.expert_grid(1), rounds=2)
    proper = (F.least("p_down", "p_flat", "p_up") > 0) & (F.abs(F.col("p_down") + F.col("p_flat") + F.col("p_up") - 1) < 1e-9)
    return plain(p.select("row_id", "fold", "y", proper.alias("proper")))


@query
def class_coverage(spark, sf):
    """Rows and distinct classes of every fold's training part."""
    rows, folds = expert_rows(spark, sf)
    d = rows.join(folds.where("role = 'train'"), "row_id")
    n = d.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("y").alias("present"))
    return plain(n.join(training.missing_classes(d, ["fold"]), "fold", "left").select("fold", "n", "present", F.col("classes").isNotNull().alias("lacking")))
