"""Named queries: a Spark plan on the given tables, with the equal SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, root: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, root)

        REGISTRY[name] = Query(run, sql)
        return fn

    return add


def r6(expr: str) -> str:
    """SQL of a value rounded to six digits, without negative zero."""
    return f"(CASE WHEN round({expr}, 6) = 0 THEN 0.0::DOUBLE ELSE round({expr}, 6) END)"


def sql_vector(v) -> str:
    return "[" + ",".join(repr(float(x)) for x in v) + "]"


def sql_matrix(m) -> str:
    return "[" + ",".join(sql_vector(r) for r in m) + "]"
