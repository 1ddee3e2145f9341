"""Connected components of a graph given by edges, by alternating large and small stars.

Every round is a few aggregations and equi-joins over the edges; neighbours of a node are never collected. The number of
rounds grows with the logarithm of the longest chain. Each round is cut by a reliable checkpoint. Edges that are stars already
need none: one aggregate shows this before each round, and only its answer reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

ROUNDS = 100


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: join larger neighbours of a node to the smallest node around it; small star: the smaller ones and itself."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = around.join(low, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def stars(edges: DataFrame) -> bool:
    """Whether every node of the edges (a, b), b the smaller, is either a centre or has one edge to a centre."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge (a, b); component is the smallest node reachable."""
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(ROUNDS):
        if stars(now):
            break
        now = cut_lineage(_star(_star(now, True), False))
    else:
        raise RuntimeError(f"no end after {ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
