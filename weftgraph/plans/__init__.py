"""Registered queries: importing this package registers them all."""

from . import claim_queries, graph_queries, kg_queries, more_queries, reply_queries, text_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "claim_queries", "graph_queries", "kg_queries", "more_queries", "reply_queries", "text_queries"]
