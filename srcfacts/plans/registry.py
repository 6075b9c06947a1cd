"""All queries of the library itself, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from srcfacts.plans.standins import Inputs, with_ctes

MODULES = ("mining_queries", "log_queries", "experiment_queries", "code_queries", "file_queries")
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def add(name: str, query: Callable[[Inputs], DataFrame], sql: str | None = None) -> None:
    """Registers a query over the stand-in inputs; without SQL where SQL can't express it."""
    if name in _queries:
        raise ValueError(f"{name} is registered twice")
    _queries[name] = lambda spark, sf_dir: query(Inputs(spark, sf_dir))
    if sql is not None:
        _oracles[name] = with_ctes(sql)


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"srcfacts.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact linear transfers of every segment."""
    return queries()["m04_linear"](spark, sf_dir)
