"""Versioned chunk index: appended parts by source bucket and a manifest (OP-S6, OP-S7, OP-X1).

A refresh writes one new part: the new rows of the refreshed sources and the list of these sources, both
partitioned by a hash bucket of the source path.  A source's rows are those of the last part
that lists it, so nothing old is rewritten.  A bucket whose parts become too many, or hold more
rows of later parts than its first one, is written anew within the refresh that finds it so.

The manifest lists the parts of every bucket.  It is written last, as a new version: a failed refresh
leaves the old version, and readers of a version see all of it or nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of a bucket before it is written anew.
MOST_PARTS = 16
MANIFEST = "bucket int, part int, rows long, sources long, buckets int, tag string, row_schema string"


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("source_path"), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, root: str) -> tuple[int, list]:
    """(current version, its rows: at most buckets x MOST_PARTS)."""
    rows = spark.read.schema(f"{MANIFEST}, version int").parquet(f"{root}/manifest")
    last = rows.agg(F.max("version")).first()[0]
    return last, rows.where(F.col("version") == last).collect()


def _live(spark: SparkSession, root: str, entries: list, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, sources) of the manifest entries: columns of the index with bucket and part."""
    place = [T.StructField("bucket", T.IntegerType()), T.StructField("part", T.IntegerType())]

    def read(kind: str, fields, size: str) -> DataFrame:
        full = T.StructType([*fields, *place])
        paths = [f"{root}/{kind}/part={e['part']}/bucket={e['bucket']}" for e in entries if e[size]]
        return spark.read.schema(full).option("basePath", f"{root}/{kind}").parquet(*paths) if paths else spark.createDataFrame([], full)

    sources = read("sources", [schema["source_path"]], "sources").groupBy("bucket", "source_path").agg(F.max("part").alias("part"))
    rows = read("chunks", schema.fields, "rows").join(sources, ["bucket", "source_path", "part"], "left_semi")
    return rows, sources


def _write_part(spark: SparkSession, root: str, part: int, rows: DataFrame, sources: DataFrame, buckets: int, schema: T.StructType) -> dict[int, tuple[int, int]]:
    """Write rows and sources by bucket; (rows, sources) of each bucket."""
    b = _bucket(buckets)
    # A bucket goes to a few tasks, not to all: files are then about as many as tasks, not tasks x buckets.
    tasks = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets))
    share = F.pmod(F.xxhash64("source_path", F.lit(1)), F.lit(tasks))
    rows.select(*schema.names).withColumn("bucket", b).repartition("bucket", share).write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/chunks/part={part}")
    sources.select("source_path").distinct().withColumn("bucket", b).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/sources/part={part}")
    bucket = T.StructField("bucket", T.IntegerType())
    n = spark.read.schema(T.StructType([*schema.fields, bucket])).parquet(f"{root}/chunks/part={part}").groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    m = spark.read.schema(T.StructType([schema["source_path"], bucket])).parquet(f"{root}/sources/part={part}").groupBy("bucket").agg(F.count(F.lit(1)).alias("sources"))
    return {r["bucket"]: (r["rows"] or 0, r["sources"]) for r in m.join(n, "bucket", "left").collect()}  # a row a bucket


def _commit(spark: SparkSession, root: str, version: int, entries: list[tuple], buckets: int, tag: str | None, schema: T.StructType) -> None:
    rows = [(b, p, r, s, buckets, tag, schema.json()) for b, p, r, s in entries]
    spark.createDataFrame(rows or [(None, None, 0, 0, buckets, tag, schema.json())], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/version={version}")


def create_index(root: str, rows: DataFrame, buckets: int = 64, version: int = 0) -> None:
    """A new index of ``rows``, or as a later ``version`` a full reindex of the one at ``root``."""
    spark, schema = rows.sparkSession, rows.schema
    sizes = _write_part(spark, root, version, rows, rows.select("source_path"), buckets, schema)
    _commit(spark, root, version, [(b, version, *n) for b, n in sizes.items()], buckets, None, schema)


def reindex(root: str, rows: DataFrame) -> int:
    """Every source replaced: the next version holds ``rows`` only."""
    version, current = manifest(rows.sparkSession, root)
    create_index(root, rows, current[0]["buckets"], version + 1)
    return version + 1


def refresh_index(root: str, updated: DataFrame, build: Callable[[DataFrame], DataFrame], tag: str | None = None) -> int:
    """Replace the rows of the sources of ``updated`` (source_path, ...) by ``build(updated)``; the version then current.

    Nothing is written when there is no source.  A refresh whose ``tag`` the current version
    carries has been done already.  A source without new rows ends without rows."""
    spark = updated.sparkSession
    version, current = manifest(spark, root)
    if tag is not None and current[0]["tag"] == tag:
        return version
    buckets, schema = current[0]["buckets"], T.StructType.fromJson(json.loads(current[0]["row_schema"]))
    current = [e for e in current if e["bucket"] is not None]
    sources = updated.select("source_path").distinct()
    touched = [r["b"] for r in sources.select(_bucket(buckets).alias("b")).distinct().collect()]  # at most ``buckets``
    if not touched:
        return version
    by_bucket: dict[int, list] = {}
    for e in sorted(current, key=lambda e: e["part"]):
        by_bucket.setdefault(e["bucket"], []).append(e)
    due = [b for b in touched if (of := by_bucket.get(b)) and (len(of) >= MOST_PARTS or sum(e["rows"] for e in of[1:]) > of[0]["rows"])]
    rows, listed = build(updated), sources
    if due:
        old, old_sources = _live(spark, root, [e for b in due for e in by_bucket[b]], schema)
        rows = rows.select(*schema.names).unionByName(old.join(sources, "source_path", "left_anti").select(*schema.names))
        listed = listed.unionByName(old_sources.select("source_path"))
    sizes = _write_part(spark, root, version + 1, rows, listed, buckets, schema)
    kept = [(e["bucket"], e["part"], e["rows"], e["sources"]) for e in current if e["bucket"] not in due]
    _commit(spark, root, version + 1, kept + [(b, version + 1, *n) for b, n in sizes.items()], buckets, tag, schema)
    return version + 1


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the current version."""
    _, entries = manifest(spark, root)
    schema = T.StructType.fromJson(json.loads(entries[0]["row_schema"]))
    return _live(spark, root, [e for e in entries if e["bucket"] is not None], schema)[0].select(*schema.names)
