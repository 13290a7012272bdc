"""All registered queries."""

from __future__ import annotations

from commentlens.plans import live_queries, review_queries, store_queries, text_queries  # noqa: F401
from commentlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
