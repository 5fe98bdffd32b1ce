"""All registered queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomery.plans import agents, history, memory, search, texts

MODULES = [history, texts, search, memory, agents]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return search.bm25_topk(spark, folder)
