"""Queries over the shared tables, with the same results in SQL."""

from __future__ import annotations

from . import alignment_queries, annotation_queries, event_queries, function_queries, layout_queries, matching_queries, pattern_queries, record_queries, refine_queries, spatial_queries, store_queries, tabular_queries

QUERIES: dict = {}
ORACLE: dict = {}
for _module in (alignment_queries, annotation_queries, pattern_queries, refine_queries, store_queries, tabular_queries, record_queries, event_queries, spatial_queries, matching_queries, layout_queries, function_queries):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
