"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storyloom.plans import catalog_items, catalog_search, catalog_sources, catalog_text, registry  # noqa: F401
from storyloom.session import tune


def _prepared(fn: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _prepared(fn) for name, fn in registry.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
