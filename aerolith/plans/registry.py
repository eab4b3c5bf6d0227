"""Where queries register themselves, with the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name; without SQL it is tested by its invariants."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str, share: int) -> DataFrame:
    """Rows dealt out by their key, some ``share`` of them a task.

    A row that becomes thousands of cells is small in its file, and the file would be one task's work. What is grouped
    by the key and more then finds its rows together.
    """
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // share))
    return rows.repartition(parts, key)
