"""Registration of queries, and small fixtures that both engines read as the same VALUES."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registrar() -> tuple[dict[str, Query], dict[str, str], Callable]:
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None):
        def add(f: Query) -> Query:
            queries[f.__name__] = f
            if text is not None:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, columns: str, rows: str) -> DataFrame:
    """An inline table, from the same VALUES text that the SQL side uses."""
    return spark.sql(f"SELECT * FROM (VALUES {rows}) AS t({columns})")
