"""Decision policies as column expressions. Boundaries are inclusive or strict as noted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.constants import (
    DEFAULT_COST,
    MODE_SERVES,
    NEUTRAL_MIN,
    PILLARS,
    PLAIN_MIN,
    PUBLISHED_MODES,
    STRONG_MIN,
    by_horizon,
    prior,
)
from tidemark.functions.numeric import clamp01, largest_class
from tidemark.functions.timing import col, seconds_between


# ---- freshness ----------------------------------------------------------------------------
def freshness(last: Column | str, now: Column | str, cadence_s, half_life_s=3600.0,
              hard_stop_s=7200.0) -> Column:
    """Struct(state, factor, hard_stop, age_s, overdue_s).

    Age at the hard stop counts as stale; a source exactly on cadence is healthy.
    """
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    age = F.greatest(F.lit(0.0), seconds_between(last, now))
    overdue = F.greatest(F.lit(0.0), age - lit(cadence_s))
    stale = age >= lit(hard_stop_s)
    return F.struct(
        F.when(stale, "STALE").when(overdue == 0, "HEALTHY").otherwise("LATE").alias("state"),
        F.when(stale, F.lit(0.0)).when(overdue == 0, F.lit(1.0))
        .otherwise(clamp01(F.pow(F.lit(2.0), -overdue / lit(half_life_s)))).alias("factor"),
        stale.alias("hard_stop"), age.alias("age_s"),
        overdue.alias("overdue_s"))


def tape_stale(last: Column | str, cutoff: Column | str, horizon: Column | str = "horizon") -> Column:
    """Strictly older than the horizon limit, so age equal to the limit is not stale."""
    return seconds_between(last, cutoff) > by_horizon("tape_stop_s", horizon)


def linear_freshness(age_s: Column, full_s: float, fade_s: float) -> Column:
    """1 up to full_s, then a straight line to 0 over fade_s (feed status)."""
    return F.when(age_s <= full_s, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), 1.0 - (age_s - full_s) / fade_s))


# ---- coverage and quality -----------------------------------------------------------------
def coverage_mode(active: dict[str, Column]) -> Column:
    """Mode of an exact pillar mask; NULL when the mask is not supported."""
    t, m, e, n = (active[p] for p in ("technical", "macro", "etf", "news"))
    return (F.when(t & m & ~e & ~n, F.lit("TECH_MACRO"))
            .when(t & m & ~e & n, F.lit("CORE_NO_ETF"))
            .when(t & m & e & n, F.lit("FULL")))


def mode_serves(approved: Column | str, resolved: Column | str) -> Column:
    """True when a bundle approved for one mode may serve a snapshot of the other."""
    a, r = col(approved), col(resolved)
    out = F.lit(False)
    for mode, served in MODE_SERVES.items():
        out = F.when(a == mode, r.isin(*served)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def system_quality(scores: dict[str, Column], horizon: Column | str = "horizon") -> Column:
    """Prior-weighted quality over all four pillars; a missing pillar counts zero."""
    terms = [prior(p, horizon) * F.coalesce(scores[p], F.lit(0.0)) for p in PILLARS]
    return clamp01(sum(terms[1:], terms[0]))


def mask_quality(scores: dict[str, Column], active: dict[str, Column],
                 horizon: Column | str = "horizon") -> Column:
    """Prior-weighted quality over the active pillars only; zero for an empty mask."""
    num = [F.when(active[p], prior(p, horizon) * F.coalesce(scores[p], F.lit(0.0))).otherwise(0.0)
           for p in PILLARS]
    den = [F.when(active[p], prior(p, horizon)).otherwise(0.0) for p in PILLARS]
    top, bottom = sum(num[1:], num[0]), sum(den[1:], den[0])
    return F.when(bottom > 0, clamp01(top / bottom)).otherwise(0.0)


# ---- hurdle and outcome -------------------------------------------------------------------
def economic_hurdle(volatility: Column, horizon: Column | str = "horizon",
                    cost: Column | float = DEFAULT_COST, interval_s: float = 60.0) -> Column:
    """max(cost, k·σ·√(forecast / sampling interval), b); negative σ counts as zero."""
    c = cost if isinstance(cost, Column) else F.lit(cost)
    sigma = F.greatest(F.lit(0.0), volatility) * F.sqrt(by_horizon("forecast_s", horizon) / interval_s)
    return F.greatest(c, by_horizon("k", horizon) * sigma, by_horizon("b", horizon))


def outcome_class(entry: Column, exit_: Column, theta: Column) -> Column:
    """UP or DOWN only beyond the hurdle (strict); NULL for prices that are not positive."""
    r = F.ln(exit_ / entry)
    return F.when((entry > 0) & (exit_ > 0),
                  F.when(r > theta, "UP").when(r < -theta, "DOWN").otherwise("FLAT"))


CLASS_INDEX = {"DOWN": 0, "FLAT": 1, "UP": 2}


def class_index(outcome: Column) -> Column:
    out = None
    for name, i in CLASS_INDEX.items():
        out = F.when(outcome == name, F.lit(i)) if out is None else out.when(outcome == name, F.lit(i))
    return out


# ---- label ladder -------------------------------------------------------------------------
def agreeing_pillars(predictions: list[tuple[Column, Column, Column]], direction: str) -> Column:
    """Pillars (p_down, p_flat, p_up) whose directional probability beats both others strictly."""
    hits = []
    for d, f, u in predictions:
        a, b = (u, d) if direction == "UP" else (d, u)
        hits.append(F.when((a > f) & (a > b), 1).otherwise(0))
    return sum(hits[1:], hits[0])


def label_ladder(p_down: Column, p_flat: Column, p_up: Column, quality: Column, mode: Column,
                 reliability_lower: Column, event_block: Column, calibrated: Column,
                 suppress: Column, agree_up: Column, agree_down: Column) -> Column:
    """Struct(status, label, confidence, confidence_event, reason) by the first rule that holds."""
    def unavailable(reason):
        return ("UNAVAILABLE", None, None, None, reason)

    def strong(target, other, agree):
        return ((mode == "FULL") & ~event_block & calibrated
                & (target >= STRONG_MIN["prob"]) & (target - other >= STRONG_MIN["margin"])
                & (quality >= STRONG_MIN["quality"])
                & F.coalesce(reliability_lower >= STRONG_MIN["reliability"], F.lit(False))
                & (agree >= STRONG_MIN["pillars"]))

    def plain(target, other):
        return ((quality >= PLAIN_MIN["quality"]) & (target >= PLAIN_MIN["prob"])
                & (target - other >= PLAIN_MIN["margin"]))

    up, down, flat = "UP_ABOVE_FROZEN_HURDLE", "DOWN_BELOW_FROZEN_HURDLE", "FLAT_WITHIN_FROZEN_HURDLE"
    rules = [
        (suppress, unavailable("EVENT_BLACKOUT")),
        (~F.coalesce(mode.isin(*PUBLISHED_MODES), F.lit(False)), unavailable("UNSUPPORTED_SOURCE_MASK")),
        (~calibrated, unavailable("UNCALIBRATED_COHORT")),
        (event_block & (quality < 0.75), unavailable("EVENT_BLACKOUT")),
        (strong(p_up, p_down, agree_up), ("READY", "Strong Buy", p_up, up, None)),
        (strong(p_down, p_up, agree_down), ("READY", "Strong Sell", p_down, down, None)),
        (plain(p_up, p_down), ("READY", "Buy", p_up, up, None)),
        (plain(p_down, p_up), ("READY", "Sell", p_down, down, None)),
        ((quality >= NEUTRAL_MIN["quality"]) & (p_flat >= NEUTRAL_MIN["prob"])
         & (largest_class(p_down, p_flat, p_up) == "FLAT"), ("READY", "Neutral", p_flat, flat, None)),
    ]

    def result(values):
        status, label, confidence, event, reason = values
        text = lambda v: F.lit(v).cast("string")
        conf = F.lit(None).cast("double") if confidence is None else confidence
        return F.struct(text(status).alias("status"), text(label).alias("label"),
                        conf.alias("confidence"), text(event).alias("confidence_event"),
                        text(reason).alias("reason"))

    out = F.when(rules[0][0], result(rules[0][1]))
    for cond, values in rules[1:]:
        out = out.when(cond, result(values))
    return out.otherwise(result(("ABSTAIN", None, None, None, "LOW_CONVICTION")))


def projected_status(status: Column | str, expires_at: Column | str, now: Column) -> Column:
    """READY signals read as EXPIRED from their expiry on."""
    s = col(status)
    return F.when((s == "READY") & (now >= col(expires_at)), F.lit("EXPIRED")).otherwise(s)
