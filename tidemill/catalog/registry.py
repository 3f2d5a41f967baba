"""A module's table of queries."""

from __future__ import annotations


def registry() -> tuple[dict, dict, callable]:
    """(queries, sql forms, decorator). `name` is needed where it differs from the function's."""
    queries, oracles = {}, {}

    def query(sql: str | None = None, name: str | None = None):
        def register(fn):
            queries[name or fn.__name__] = fn
            if sql:
                oracles[name or fn.__name__] = sql
            return fn

        return register

    return queries, oracles, query
