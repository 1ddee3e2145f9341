"""Fixed values of the data model. They must equal the published policy values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: horizons (seconds unless said otherwise) -------------------------------
HORIZONS = {
    "scalp_15m": dict(forecast_s=900, delay_s=3, ttl_s=90, cadence_s=60, k=0.25, b=0.001,
                      tape_stop_s=10, cooldown_s=900, severe_delay_s=30,
                      news_short_s=900, news_long_s=3600, news_half_life_s=1800),
    "swing_24h": dict(forecast_s=86400, delay_s=10, ttl_s=1200, cadence_s=900, k=0.35, b=0.003,
                      tape_stop_s=60, cooldown_s=14400, severe_delay_s=300,
                      news_short_s=3600, news_long_s=86400, news_half_life_s=21600),
    "position_30d": dict(forecast_s=2592000, delay_s=60, ttl_s=21600, cadence_s=14400, k=0.50,
                         b=0.015, tape_stop_s=300, cooldown_s=86400, severe_delay_s=3600,
                         news_short_s=86400, news_long_s=604800, news_half_life_s=172800),
}

# ---- fixed values: pillars, modes, priors ------------------------------------------------
PILLARS = ("technical", "macro", "etf", "news")
PRIORS = {
    "scalp_15m": {"technical": 0.75, "macro": 0.05, "etf": 0.05, "news": 0.15},
    "swing_24h": {"technical": 0.35, "macro": 0.20, "etf": 0.25, "news": 0.20},
    "position_30d": {"technical": 0.25, "macro": 0.30, "etf": 0.30, "news": 0.15},
}
MODE_PILLARS = {
    "FULL": ("technical", "macro", "etf", "news"),
    "CORE_NO_ETF": ("technical", "macro", "news"),
    "TECH_MACRO": ("technical", "macro"),
    "RESEARCH": ("technical", "macro", "etf", "news"),
}
PUBLISHED_MODES = ("FULL", "CORE_NO_ETF", "TECH_MACRO")
MODE_SERVES = {
    "FULL": ("FULL", "CORE_NO_ETF", "TECH_MACRO"),
    "CORE_NO_ETF": ("CORE_NO_ETF", "TECH_MACRO"),
    "TECH_MACRO": ("TECH_MACRO",),
    "RESEARCH": ("RESEARCH",),
}
FEATURE_PREFIX = {"technical": "tech_", "macro": "macro_", "etf": "etf_", "news": "news_"}
MAX_SCALARS = 192

# ---- fixed values: labels, statuses, reasons ----------------------------------------------
LABELS = ("Strong Buy", "Buy", "Neutral", "Sell", "Strong Sell")
ALERT_LABELS = ("Strong Buy", "Buy", "Sell", "Strong Sell")
STATUSES = ("READY", "ABSTAIN", "UNAVAILABLE", "EXPIRED")
REASONS = (
    "LOW_CONVICTION", "REQUIRED_MARKET_DATA_STALE", "UNSUPPORTED_SOURCE_MASK",
    "UNCALIBRATED_COHORT", "EVENT_BLACKOUT", "RIGHTS_BLOCKED", "MODEL_APPROVAL_EXPIRED",
)
FACTOR_CODES = {
    ("technical", "UP"): "TECH_MOMENTUM_SUPPORT",
    ("technical", "DOWN"): "TECH_TREND_SUPPORT",
    ("etf", "UP"): "ETF_RECENT_FLOW_SUPPORT",
    ("etf", "DOWN"): "ETF_OUTFLOW_PRESSURE",
    ("macro", "UP"): "MACRO_INFLATION_EASING",
    ("macro", "DOWN"): "MACRO_RATE_PRESSURE",
    ("news", "UP"): "NEWS_SENTIMENT_BULLISH",
    ("news", "DOWN"): "NEWS_REGULATORY_HEADWIND",
}
STRONG_MIN = dict(prob=0.75, margin=0.40, quality=0.90, pillars=2, reliability=0.60)
PLAIN_MIN = dict(prob=0.60, margin=0.20, quality=0.75)
NEUTRAL_MIN = dict(prob=0.50, quality=0.75)
DAILY_ALERTS = 8
CONFIDENCE_STEP = 0.10
DEFAULT_COST = 0.0005
ECE_GATE = 0.08

# ---- fixed values: news -------------------------------------------------------------------
NEWS_STATUSES = ("RUMOR", "ANNOUNCED", "EFFECTIVE", "DENIED", "CORRECTED")
TITLE_LIMIT = 8000
POLL_STOP_S = 3600
ARTICLES_PER_POLL = 250
JACCARD_MIN = 0.85
SIMILAR_WITHIN_S = 48 * 3600
CANDIDATE_LIMIT = 512
PUBLISHER_SHARE = 0.30
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
                   "fbclid", "gclid")
TEXT_HEADS = {
    "sentiment": ("NEGATIVE", "NEUTRAL", "POSITIVE"),
    "BTC": ("IRRELEVANT", "RELEVANT"),
    "ETH": ("IRRELEVANT", "RELEVANT"),
    "status": NEWS_STATUSES,
}
TEXT_GATE = dict(annotated_items=2000, holdout_items=400, sentiment_macro_f1=0.75,
                 relevance_macro_f1=0.85, alpha=0.67)

# ---- fixed values: macro, rights, execution, events ---------------------------------------
CPI_SERIES = {
    "CUSR0000SA0": ("US_CPI_HEADLINE_SA", True),
    "CUUR0000SA0": ("US_CPI_HEADLINE_NSA", False),
    "CUSR0000SA0L1E": ("US_CPI_CORE_SA", True),
    "CUUR0000SA0L1E": ("US_CPI_CORE_NSA", False),
}
RATE_SERIES = {
    "RIFSPFF_N.B": "US_EFFR",
    "RIFLGFCY02_N.B": "US_UST_2Y",
    "RIFLGFCY10_N.B": "US_UST_10Y",
}
OPERATIONS = ("COLLECT", "RETAIN_RAW", "COMPUTE_FEATURES", "TRAIN_ML", "INFER_ML",
              "SERVE_DISPLAY", "DISTRIBUTE_SIGNAL", "EXPORT_RAW")
COST_SCENARIOS = (
    # scenario, fee_bps, impact_bps, spread_multiplier, spread_floor_bps, severe delay applies
    ("PRIMARY_CONSERVATIVE", 20, 5, 1, 0, False),
    ("LOW_COST_SENSITIVITY", 2, 1, 1, 0, False),
    ("SEVERE_COST", 60, 20, 2, 20, True),
)
MAX_EVENT_BYTES = 262144
MARKET_ID_RE = "^[a-z0-9_-]+:[A-Za-z0-9_-]+$"
LOOKBACK_DAYS = 365
BAR_DELAY_S = 2


def horizons_df(spark: SparkSession) -> DataFrame:
    """The three horizons as a constant table (3 rows)."""
    names = list(next(iter(HORIZONS.values())))
    rows = [(h, *[float(v[n]) if n in ("k", "b") else int(v[n]) for n in names])
            for h, v in HORIZONS.items()]
    cols = ", ".join(f"{n} {'double' if n in ('k', 'b') else 'int'}" for n in names)
    return spark.createDataFrame(rows, f"horizon string, {cols}")


def by_horizon(field: str, horizon: Column | str = "horizon", dtype: str = "double") -> Column:
    """A horizon constant as a column expression; NULL for an unknown horizon."""
    h = F.col(horizon) if isinstance(horizon, str) else horizon
    out = None
    for name, values in HORIZONS.items():
        lit = F.lit(values[field]).cast(dtype)
        out = F.when(h == name, lit) if out is None else out.when(h == name, lit)
    return out


def prior(pillar: str, horizon: Column | str = "horizon") -> Column:
    """Full-mode prior weight of a pillar as a column expression."""
    h = F.col(horizon) if isinstance(horizon, str) else horizon
    out = None
    for name, weights in PRIORS.items():
        lit = F.lit(weights[pillar])
        out = F.when(h == name, lit) if out is None else out.when(h == name, lit)
    return out
