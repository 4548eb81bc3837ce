"""Queries register here with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name; ``sql`` gives the same rows in DuckDB."""

    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """Rows of a statement over whole tables, written so that Spark and DuckDB read it alike; ``{name}`` stands for a table."""
    return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in names})


def in_duckdb(sql: str, *names: str) -> str:
    """The same statement for DuckDB, where the tables are views of their names."""
    return sql.format(**{name: name for name in names})
