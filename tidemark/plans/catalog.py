"""All runnable queries by name."""

from tidemark.plans import catalog_checks, catalog_market, catalog_news, catalog_policy, catalog_streams, catalog_training  # noqa: F401
from tidemark.plans.registry import QUERIES

__all__ = ["QUERIES"]
