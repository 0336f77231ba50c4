"""Scanning and writing tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.schemas import TABLES

#: Date column each large table is partitioned by, so day filters prune folders.
PARTITION_BY = {
    "crawl_logs": "started_at",
    "jobs": "discovered_at",
    "job_activities": "created_at",
    "job_feedback": "created_at",
}


def scan(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """A Parquet table; with ``name`` the schema is the declared one."""
    reader = spark.read.schema(TABLES[name]) if name else spark.read
    return reader.parquet(path)


def next_version(root: str) -> str:
    return f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"


def write_version(df: DataFrame, root: str, name: str | None = None) -> str:
    """Write a new version of a table beside the old one and return its path.

    Readers move to the returned path; a lost executor or a failed write leaves
    the former version untouched.
    """
    path = next_version(root)
    column = PARTITION_BY.get(name or "")
    if column and column in df.columns:
        # rebalance cuts a big day into several files and joins small ones
        dated = df.withColumn(f"{column}_day", F.to_date(column)).hint("rebalance", f"{column}_day")
        dated.write.partitionBy(f"{column}_day").parquet(path)
    else:
        df.write.parquet(path)
    return path
