"""All queries of the subpackage, and SQL where it can express them."""

from __future__ import annotations

from . import (
    queries_audit,
    queries_corpus,
    queries_license,
    queries_lines,
    queries_models,
    queries_rules,
    queries_substring,
    queries_vectors,
)

_MODULES = (
    queries_models, queries_lines, queries_corpus, queries_rules, queries_license, queries_substring,
    queries_audit, queries_vectors,
)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
