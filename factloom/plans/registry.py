"""The registered queries and their DuckDB twins, and small helpers of both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its twin if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def any_sql(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def case_sql(column: str, words: dict[str, list[str]], other: str) -> str:
    """The first name with a word in the column."""
    return "CASE " + " ".join(f"WHEN {any_sql(column, w)} THEN '{name}'" for name, w in words.items()) + f" ELSE {other} END"


def in_sql(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"
