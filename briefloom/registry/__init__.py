"""Every registered query with, where SQL can express it, the DuckDB query giving the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function under ``name``."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def load_all() -> None:
    import importlib
    for family in FAMILIES:
        importlib.import_module(f"{__name__}.{family}")


FAMILIES = ["cleaning", "segments", "clauses", "labels", "entities", "risks", "retrieval", "tables", "streams"]
