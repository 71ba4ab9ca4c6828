"""All registered queries."""

from mendframe.plans import detect_queries, profile_queries, score_queries, table_queries
from mendframe.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES", "detect_queries", "profile_queries", "score_queries", "table_queries"]
