"""The named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from cartoload.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(body: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return body(configure(spark), folder)

        run.__name__, run.__doc__ = name, body.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return body

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
