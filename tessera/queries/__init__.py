"""Queries of the memory-graph operators over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import building, graph, ranking, retrieval, search

MODULES = (search, ranking, graph, retrieval, building)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, (f, _) in module.REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.REGISTRY.items() if sql}
