"""Registered queries over the test tables and their SQL twins."""

from __future__ import annotations

from . import extension_queries, layout_queries, policy_queries, record_queries, state_queries, text_queries

_MODULES = (text_queries, layout_queries, state_queries, policy_queries, record_queries, extension_queries)


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.oracle_sql().items()}
