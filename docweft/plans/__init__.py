"""Registered queries with their SQL forms."""

from . import briefing_queries, case_queries, file_queries, layout_queries, record_queries, source_queries, stream_queries, table_queries, text_queries  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
