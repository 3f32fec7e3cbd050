"""Chunk-index maintenance: refresh selection, absence probe, replace-by-source (OP-S4..S7, OP-J6, OP-C12).

The index is an immutable table version: a refresh writes a new version
(old rows of untouched sources + new rows of refreshed sources) and never
overwrites the path it reads.  Sources removed from disk are not purged
(the reference does not purge them either).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.chunking import chunk_markdown
from quarry.operators.embedding import DEFAULT_DIM, embed_hashing

# Fixed value: default refresh window in days.
DEFAULT_DAYS_AGO = 3


def refresh_window(setting) -> Column:
    """Days of the refresh window: the setting as a whole number of days, else the default."""
    days = F.lit(None if setting is None else str(setting)).try_cast("int")
    return F.when(days >= 0, days).otherwise(F.lit(DEFAULT_DAYS_AGO))


def index_missing(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files whose source has no row in the index (batch form of the EXISTS probe)."""
    return files.join(index.select("source_path").distinct(), "source_path", "left_anti")


def refresh_select(files: DataFrame, index: DataFrame, now, days=DEFAULT_DAYS_AGO) -> DataFrame:
    """Files that are recent (mtime >= now - days) or absent from the index."""
    kind = files.schema["modified_at"].dataType  # compare in the column's own type (with or without zone)
    cutoff = F.lit(now).cast(kind) - F.make_dt_interval(refresh_window(days))
    recent = F.col("modified_at") >= cutoff
    present = index.select("source_path").distinct().withColumn("_present", F.lit(True))
    return (files.join(present, "source_path", "left")
            .where(recent | F.col("_present").isNull()).drop("_present"))


def build_chunks(files: DataFrame, processed_at, dim: int = DEFAULT_DIM) -> DataFrame:
    """Selected files -> index rows (chunk, embed, stamp)."""
    chunks = chunk_markdown(files.select("source_path", "content"))
    stamped = chunks.join(files.select("source_path", "modified_at"), "source_path")
    return (embed_hashing(stamped, "content", dim=dim)
            .select("source_path", "chunk_index", "content", "embedding",
                    F.col("modified_at").alias("source_last_updated_date"),
                    (processed_at if isinstance(processed_at, Column) else F.lit(processed_at).cast("timestamp")).alias("last_processed_date")))


def index_replace(old: DataFrame, new_rows: DataFrame, updated_sources: DataFrame) -> DataFrame:
    """Replace-by-source: drop every old row of an updated source, add its new rows.

    A shrunk file leaves no stale chunk; sources absent from ``updated_sources``
    keep their rows untouched.
    """
    kept = old.join(updated_sources.select("source_path").distinct(), "source_path", "left_anti")
    return kept.unionByName(new_rows.select(*old.columns))
