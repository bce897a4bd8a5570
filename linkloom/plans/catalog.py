"""Registered queries over the reference operators, with the SQL that states each result."""

from __future__ import annotations

from linkloom.plans import catalog_corpora, catalog_enrich, catalog_graph, catalog_knowledge, catalog_more, catalog_projection, catalog_repo, catalog_search

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (catalog_graph, catalog_corpora, catalog_search, catalog_knowledge, catalog_repo, catalog_more, catalog_projection, catalog_enrich):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.SQL
FLAGSHIP = "planned_search"
