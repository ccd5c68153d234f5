"""All registered queries."""

from lectern.plans import anchor_queries, chunk_queries, graph_queries, library_queries, operator_queries, repair_queries, search_queries, text_queries, validation_queries  # noqa: F401
from lectern.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
