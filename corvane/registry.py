"""All queries of the engine with their SQL forms."""

from __future__ import annotations

from .queries import catalog, changes, content, declared, details, failures, files, graph, keyword, nearest, upkeep

_MODULES = (catalog, content, graph, changes, keyword, details, failures, files, upkeep, declared, nearest)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
FLAGSHIP = content.q7_8_hybrid
