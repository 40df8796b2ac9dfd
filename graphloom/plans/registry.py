"""Registry of queries with the SQL that checks them."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under a name, with SQL that gives the same rows."""

    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register
