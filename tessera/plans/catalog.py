"""Registry of the engine's queries and of the SQL that checks them."""

from __future__ import annotations

from tessera.plans import linked_queries, model_queries, more_queries, query_queries, rank_queries, rest_queries, result_queries, source_queries, text_queries, understanding_queries, vertical_queries

_MODULES = [text_queries, rank_queries, query_queries, more_queries, rest_queries, result_queries, vertical_queries, source_queries, understanding_queries, linked_queries, model_queries]
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
