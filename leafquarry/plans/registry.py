"""Queries by name, each with the SQL that states its result for DuckDB where SQL can."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
#: By name: rows of (*arguments, result) and the function of Columns; tests evaluate them.
CASES: dict[str, tuple[list[tuple], Callable]] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add
