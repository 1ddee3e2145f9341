"""Small numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.timing import col


def clamp01(c: Column | str) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), col(c)))


def pct_change(value: Column, previous: Column) -> Column:
    """100·(value/previous − 1); NULL without a previous value or when it is zero."""
    return F.when(previous.isNotNull() & (previous != 0.0),
                  F.lit(100.0) * (value / previous - F.lit(1.0)))


def bps_change(value: Column, previous: Column) -> Column:
    return (value - previous) * F.lit(100.0)


def floored_ln(p: Column, floor: float = 1e-6) -> Column:
    return F.ln(F.greatest(p, F.lit(floor)))


def softmax(logits: list[Column]) -> list[Column]:
    """Shifted softmax over a fixed list of columns."""
    top = F.greatest(*logits)
    terms = [F.exp(z - top) for z in logits]
    total = sum(terms[1:], terms[0])
    return [t / total for t in terms]


def largest_class(p_down: Column | str, p_flat: Column | str, p_up: Column | str) -> Column:
    """UP or DOWN only when strictly above both others, otherwise FLAT."""
    d, f, u = col(p_down), col(p_flat), col(p_up)
    return (F.when((u > f) & (u > d), F.lit("UP"))
            .when((d > f) & (d > u), F.lit("DOWN"))
            .otherwise(F.lit("FLAT")))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
