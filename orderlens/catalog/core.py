"""Registry of the checked queries: a Spark job and, beside it, its SQL twin.

The SQL is written against the driver's tables; shared relations are listed in
``catalog.relations`` and only those a query names are put in front of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderlens.operators.order_level import build_order_level
from orderlens.sources.driver_tables import order_tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with its SQL twin, if it has one."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def order_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order-level table over the given test tables."""
    return build_order_level(order_tables(spark, sf_dir))


def complete_sql(sql: str, relations: dict[str, str]) -> str:
    """``sql`` preceded by the shared relations it needs, in definition order."""
    needed: set[str] = set()
    pending = [sql]
    while pending:
        text = pending.pop()
        for name, body in relations.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                pending.append(body)
    chosen = [f"{n} AS ({b})" for n, b in relations.items() if n in needed]
    sql = sql.strip()
    if not chosen:
        return sql
    if sql[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(chosen) + ",\n" + sql[5:]
    return "WITH " + ",\n".join(chosen) + "\n" + sql
