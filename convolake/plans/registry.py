"""All queries over the driver tables, by name."""

from __future__ import annotations

from convolake.plans import activity, maintenance, retrieval, sessions, surface, texts, upkeep

_MODULES = (retrieval, sessions, activity, maintenance, texts, surface, upkeep)
FLAGSHIP = retrieval.hybrid_search_capped
QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
