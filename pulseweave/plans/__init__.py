"""Whole jobs made of operators, and the registered queries with their SQL."""

from . import cohort_queries, event_queries, score_queries, table_queries, wave_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cohort_queries", "event_queries", "score_queries", "table_queries", "wave_queries"]
