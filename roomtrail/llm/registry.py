"""Queries of this subpackage: key -> (function, oracle SQL or None)."""

from __future__ import annotations

OPERATIONS: dict[str, tuple] = {}


def operation(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``key``."""

    def wrap(fn):
        OPERATIONS[key] = (fn, sql)
        return fn

    return wrap
