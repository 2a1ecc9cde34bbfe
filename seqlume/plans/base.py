"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL where there is any."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """The number of tasks over which a small table is dealt that grows by a join or generator."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def seconds(ts: str = "ts") -> Column:
    """Whole seconds since the start of 2024 of a time without zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', {ts})")
