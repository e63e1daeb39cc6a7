"""Registered queries over the given tables, each next to the SQL it must agree with."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_MODULES = ("gate", "catalogue", "walk", "flux", "images", "measures", "compare", "tables", "sampling", "streams")


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function and, where SQL can say it, its oracle."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    for module in _MODULES:
        importlib.import_module(f"stampmill.queries.{module}")
