"""Importing this module registers every query."""

from codequarry.plans import code_queries, composite_queries, corpus_queries, evidence_queries, graph_queries, lookup_queries, search_queries, session_queries, stream_queries  # noqa: F401
from codequarry.plans.registry import entries

__all__ = ["entries"]
