"""Registered queries of the library's own operators, and the SQL that they are held against."""

from __future__ import annotations

from veraframe.plans import audit_queries, composed_queries, incremental_queries, manifest_queries, media_queries, report_queries, score_queries, stream_queries

MODULES = (score_queries, manifest_queries, media_queries, stream_queries, composed_queries, audit_queries, report_queries, incremental_queries)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in MODULES for k, v in m.ORACLES.items()}
FLAGSHIP = "d1_adaptive_decision"
