"""Queries over the tables of a folder, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from civicflow.session import spread

Query = Callable[[SparkSession, str], DataFrame]


class Plans:
    """Named queries and, where SQL can express them, their DuckDB SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(fn: Query) -> Query:
            self.queries[fn.__name__] = fn
            if sql:
                self.sql[fn.__name__] = sql
            return fn

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df
