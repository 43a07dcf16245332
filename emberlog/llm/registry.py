"""All queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import queries_clean, queries_dedup, queries_models, queries_scans, queries_tokens, queries_web

_MODULES = [queries_models, queries_web, queries_scans, queries_dedup, queries_tokens, queries_clean]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
