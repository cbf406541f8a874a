"""All queries of the core and their SQL."""

from __future__ import annotations

from korpuskel.plans import core_problems, quality_queries, registry_queries, search_queries, text_queries

FLAGSHIP = "sparse_topk"
_MODULES = [core_problems, text_queries, search_queries, quality_queries, registry_queries]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
