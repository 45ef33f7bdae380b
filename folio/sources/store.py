"""Scratch tables, the rows of the history (kept by ``analyses``), exports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one only serves a local session that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folio-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/folio-{uuid.uuid4().hex}"


def written(rows: DataFrame, path: str) -> DataFrame:
    """The rows, written as a table and read again: patterns run once, sizes are known, a lost executor costs nothing."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def analysis_rows(decisions: DataFrame, key: str, created: str, columns: list[str]) -> DataFrame:
    """Rows to store: a content-derived id (so a repeated append can be told), the month, the columns."""
    made = F.sha2(F.concat_ws("|", key, F.col(created).cast("string"), *(F.col(c).cast("string") for c in columns)), 256)
    return decisions.select(made.alias("analysis_id"), key, F.col(created).alias("created"), F.date_format(created, "yyyy-MM").alias("month"), *columns)


def export_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; Spark writes no byte-order mark."""
    flat = rows.select(*(F.array_join(c, "; ").alias(c) if t.startswith("array<string") else F.col(c) for c, t in rows.dtypes))
    flat.write.mode("overwrite").option("header", True).csv(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
