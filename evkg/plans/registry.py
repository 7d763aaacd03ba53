"""Queries by name, and the same in DuckDB SQL."""

from __future__ import annotations

from evkg.plans.tpch import SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, graph_views: bool = True):
    """Register a function under its name; ``sql`` follows the views of the graph or stands alone."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {SQL}{sql}" if graph_views else sql
        return f

    return add
