"""All registered queries and their comparison SQL."""

from . import queries_calls, queries_dated, queries_decisions, queries_market, queries_metrics, queries_sources, queries_text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
