"""Registration of queries and the SQL snippets they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearken.functions.text import SPACES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def clean(column: str) -> str:
    """SQL for ``clean_text``."""
    return f"trim(regexp_replace(lower({column}), '{SPACES}', ' ', 'g'))"


def query(sql: str | None = None):
    """Register a query under its function name."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
