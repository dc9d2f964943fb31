"""Every registered query and its SQL twin."""

from __future__ import annotations

from notelens.plans import search_queries, table_queries

MODULES = (search_queries, table_queries)


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
