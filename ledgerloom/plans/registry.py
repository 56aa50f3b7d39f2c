"""Queries by name, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    queries: dict[str, Callable] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query


def filled(queries: dict[str, Callable], oracles: dict[str, str], name: str, *columns: str) -> None:
    """Have a query and its SQL show -1 where whole-number columns are null: a line that does not apply."""
    run = queries[name]
    queries[name] = lambda spark, sf_dir: run(spark, sf_dir).fillna(-1, list(columns))
    oracles[name] = f"select * replace ({', '.join(f'coalesce({c}, -1) as {c}' for c in columns)}) from ({oracles[name]})"
