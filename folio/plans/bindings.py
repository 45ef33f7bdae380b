"""What the query bindings share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-09-02"
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows over all cores: a small file is one partition, however much is made of its rows."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, key)


def as_of(date: str = AS_OF) -> Column:
    return F.lit(date).cast("date")


def decimal(column: str, kind: str = "decimal(18,2)") -> Column:
    """Money arrives as double; arithmetic is decimal."""
    return F.round(F.col(column), 2).cast(kind)


class Registry:
    """Collects queries with the SQL that checks them."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.oracle[name] = sql
            return f

        return keep
