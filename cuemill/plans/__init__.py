"""Queries over the driver's tables, each with its oracle where SQL has one."""

from . import flagship, load_queries, recon_queries, search_queries, source_queries, stream_queries, table_queries  # noqa: F401  they register
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
