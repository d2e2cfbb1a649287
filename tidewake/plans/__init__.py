"""All queries over the given tables, by name, with their oracles."""

from tidewake.plans import evidence_queries, lifecycle_queries, position_queries, record_queries, scan_queries, trade_queries, whole_queries, window_queries  # noqa: F401
from tidewake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
