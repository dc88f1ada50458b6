"""Names of the engine's own queries, and their SQL."""

from __future__ import annotations

from . import queries_answers, queries_catalog, queries_evidence, queries_functions, queries_lookups, queries_narrowing, queries_overrides, queries_passages, queries_policy, queries_store

_MODULES = (queries_store, queries_answers, queries_evidence, queries_lookups, queries_narrowing, queries_passages, queries_catalog, queries_policy, queries_overrides, queries_functions)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
