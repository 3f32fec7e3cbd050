"""Append-only sinks for the per-event tables and JSON result emission (OP-S8..S11).

Every write appends a new set of files (or a new partition), so a retried task
or job never rewrites what another run produced; readers see whole files only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_usage(usage: DataFrame, path: str) -> None:
    """Usage rows, partitioned by day of ``created_at`` for time-range pruning."""
    (usage.withColumn("created_date", F.to_date("created_at"))
     .write.mode("append").partitionBy("created_date").parquet(path))


def append_rows(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Judgments, session starts, answers: plain appends."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row (non-ASCII kept as is), e.g. a retrieval result set."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def emit_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
