"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, app: str = "tidemark", **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE with skew handling."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only where neither the setting nor a directory is present (single-machine tests) is a
    temporary folder used.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    have = sc.getCheckpointDir()
    if have is not None:
        return have
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "checkpoints")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never local): survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


BROADCAST_ROWS = 500_000


def small_side(keys: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a list of keys for broadcast after its rows are counted; a longer one joins by a shuffle, with the same rows. `keys` is read twice."""
    return F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy work on a narrow input all cores.

    An input with fewer splits than cores (one small file) is redistributed; a large input has
    splits enough and is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
