"""Markdown corpus from a folder tree (OP-S1..S3): recursive discovery, UTF-8 read, topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """Every ``*.md`` file below ``root``: source_path (absolute path), content, modified_at.

    Content is decoded as UTF-8 with ``\\r\\n`` folded to ``\\n``; a BOM is kept.
    """
    raw = (spark.read.format("binaryFile")
           .option("recursiveFileLookup", "true")
           .option("pathGlobFilter", "*.md")
           .load(root))
    return raw.select(
        F.regexp_replace(F.col("path"), "^file:", "").alias("source_path"),
        F.replace(F.decode(F.col("content"), "UTF-8"), F.lit("\r\n"), F.lit("\n")).alias("content"),
        F.col("modificationTime").alias("modified_at"),
    )


def list_topics(files: DataFrame, root: str) -> DataFrame:
    """Relative paths without the ``.md`` suffix, sorted (random-test topics)."""
    prefix = root.rstrip("/") + "/"
    rel = F.regexp_replace(F.col("source_path"), "^" + _quote(prefix), "")
    return (files.select(F.regexp_replace(rel, r"\.md$", "").alias("topic"))
            .distinct().orderBy("topic"))


def _quote(s: str) -> str:
    return "".join("\\" + c if c in r".^$*+?{}[]\|()" else c for c in s)
