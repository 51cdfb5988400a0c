"""All registered queries of the engine, by name, with their DuckDB SQL."""

from __future__ import annotations

from plumbline.plans import answer_queries, extraction_queries, history_queries, label_queries, review_queries, schedule_queries, service_queries, source_queries, text_queries

_MODULES = (history_queries, schedule_queries, text_queries, review_queries, label_queries, service_queries, source_queries, answer_queries, extraction_queries)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE: dict = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
