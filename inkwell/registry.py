"""All queries of the engine, by name, with their SQL."""

from __future__ import annotations

from inkwell.plans import annotation_queries, catalog_queries, compose_queries, evaluate_queries, markup_queries, payload_queries, review_queries, search_queries, text_queries

FLAGSHIP = "hybrid_search"
_ALL: dict = {}
for _module in (text_queries, search_queries, catalog_queries, compose_queries, review_queries, annotation_queries, payload_queries, evaluate_queries, markup_queries):
    _ALL |= _module.QUERIES
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
