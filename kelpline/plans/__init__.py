"""Named queries over the tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("listing", "matching", "texts", "history", "landed", "streams", "evidence", "details", "gates", "changes", "boards", "duplicates", "decisions", "pay", "markup")


def registry() -> tuple[dict, dict]:
    """All queries and all SQL of the modules, in order."""
    queries: dict = {}
    sql: dict = {}
    for name in MODULES:
        module = import_module(f"kelpline.plans.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
