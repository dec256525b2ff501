"""Queries of the engine's own operators over the driver's tables."""

from spoolwave.queries import catalog_queries, event_queries, function_queries, layout_queries, lookup_queries, signal_queries, sink_queries, source_queries, store_queries, vendor_queries  # noqa: F401
from spoolwave.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
