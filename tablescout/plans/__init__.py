"""Derived views, registered queries and their SQL counterparts."""

from tablescout.plans.registry import ORACLES, QUERIES  # noqa: F401
from tablescout.plans import audit_queries, index_queries, profile_queries, question_queries, runlog_queries, search_queries, stream_queries  # noqa: F401
