"""All registered queries and their DuckDB counterparts."""

from gleaner.plans import conversation, drafts, metadata, refresh, retrieval, warehouse

_MODULES = (retrieval, warehouse, conversation, drafts, metadata, refresh)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
