"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def load_all() -> None:
    """Import every plan module so that its queries are registered."""
    from importlib import import_module

    for module in MODULES:
        import_module(f"pricetide.plans.{module}")


MODULES: list[str] = ["summaries", "history", "snapshots", "normalised", "quality", "joins", "evaluation", "dashboard", "streams", "models"]
