"""Operators bound to the shared test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_AREAS = [
    "sources", "extract", "clean", "annotate", "responses", "assemble", "retrieve", "prompts", "scoring", "match",
    "outcomes",
]


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its oracle."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def load_all() -> None:
    for area in _AREAS:
        importlib.import_module(f"{__name__}.{area}")
