"""Collects queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits: engines sum in different orders."""
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_sql(select: str, columns: dict[str, str], digits: int = 6) -> str:
    """select's rows with the columns of kind 'd' rounded."""
    return "SELECT " + ", ".join(f"round({c}, {digits}) AS {c}" if k == "d" else c for c, k in columns.items()) + f" FROM ({select})"
