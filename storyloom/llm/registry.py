"""Queries of this subpackage and their SQL."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return deco
