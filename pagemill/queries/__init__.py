"""Queries over the driver's tables, each with SQL that states its result independently where SQL can.

Pages of the tables hold no tables, code, keywords, commands or addresses; queries that need those build pages from
orders and parts with string expressions that both engines evaluate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query over whole tables, with SQL that states its result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> tuple[dict, dict]:
    from pagemill.queries import contracts, flows, markup, network, zoning  # noqa: F401

    return QUERIES, SQL
