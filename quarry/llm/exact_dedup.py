"""Exact de-duplication as a stateful stream.

A narrow table of digests runs through Structured Streaming; RocksDB state, keyed by the
SHA-256 digest of the normalised text and never expired, retains the stable identifier that
stays, its content locator (file and row) and the number of rows seen.  The state is then read
back as a table.  A digest that was hit more than once is only trusted after its full texts
have been compared; rows of a digest whose texts differ are grouped by the text itself.
DataFrame and SQL functions only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import bounded, checkpoint_dir, write_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: State on disk; what a batch adds is logged, and small stores take no disk in advance.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def lower_ascii(col) -> Column:
    """A-Z to a-z and nothing else; null counts as empty.  Pure ASCII texts take the quick way."""
    text = F.coalesce(col, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha256(col) -> Column:
    return F.unhex(F.sha2(col, 256))


def dedup_state(digests: str, spark, batch_bytes: str | None = None) -> DataFrame:
    """Stream the digest table at path ``digests`` through keyed state and return that state:
    digest, stay (struct id, row, file, n_bytes) and group_size."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/dedup-{uuid.uuid4().hex}"
    reader = spark.readStream.schema(spark.read.parquet(digests).schema)
    if batch_bytes:
        reader = reader.option("maxBytesPerTrigger", batch_bytes)
    seen = reader.parquet(digests).groupBy("digest").agg(
        F.max(F.struct("id", "row", "file", "n_bytes")).alias("stay"), F.count(F.lit(1)).alias("group_size"))
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = (seen.writeStream.outputMode("update").format("noop")
                 .option("checkpointLocation", folder).trigger(availableNow=True).start())
        query.awaitTermination()
        state = spark.read.format("statestore").load(folder)
        return write_table(state.select("key.digest", F.col("value.max").alias("stay"), F.col("value.count").alias("group_size")), "dedup-state")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digest: Callable[[Column], Column] = sha256, batch_bytes: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id_col, keep_id, group_size, kept, text_sha256.

    Of rows whose texts are equal after lower-casing A-Z the one with the largest id stays; of
    repeated rows with that id exactly one.  Null text counts as empty, a null id as smaller
    than every other, an empty table gives an empty result; extra columns are not read.
    ``digest`` may be any function of the text: the full texts decide, whatever it returns."""
    spark = docs.sparkSession
    norm = docs.select(F.col(id_col).alias("id"), lower_ascii(F.col(text_col)).alias("text"))
    marks = norm.select("id", digest(F.col("text")).alias("digest"), F.sha2("text", 256).alias("sha") if digest is not sha256 else F.lit(None).cast("string").alias("sha"),
                        F.octet_length("text").cast("bigint").alias("n_bytes"),
                        F.monotonically_increasing_id().alias("row"), F.input_file_name().alias("file"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/digests-{uuid.uuid4().hex}"
    marks.write.parquet(path)
    marks = spark.read.parquet(path)
    state = dedup_state(path, spark, batch_bytes)
    # Full bytes of every digest seen more than once; copies collapse before the shuffle.
    hits = bounded(state.where("group_size > 1").select("digest"))
    checked = norm.select(digest(F.col("text")).alias("digest"), "text").join(hits, "digest", "left_semi").groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    clash_path = f"{checkpoint_dir(spark).rstrip('/')}/tables/clashes-{uuid.uuid4().hex}"
    checked.where("lo <> hi").select("digest").write.parquet(clash_path)
    clash = spark.read.parquet(clash_path)
    out = marks.join(state, "digest").select(
        F.col("id").alias(id_col), F.col("stay.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("stay.row")).alias("kept"),
        (F.lower(F.hex("digest")) if digest is sha256 else F.col("sha")).alias("text_sha256"), "digest")
    if clash.isEmpty():
        return out.drop("digest")
    return out.join(clash, "digest", "left_anti").drop("digest").unionByName(
        _by_text(norm.withColumn("digest", digest(F.col("text"))).join(clash, "digest", "left_semi"), id_col))


def _by_text(rows: DataFrame, id_col: str) -> DataFrame:
    """The same result for rows whose digests do not tell texts apart."""
    rows = rows.select("id", "text", F.monotonically_increasing_id().alias("row")).checkpoint()
    stay = rows.groupBy("text").agg(F.max(F.struct("id", "row")).alias("stay"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(stay, "text").select(
        F.col("id").alias(id_col), F.col("stay.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("stay.row")).alias("kept"), F.sha2("text", 256).alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that exact_dedup drops, with the columns of ``docs``."""
    marks = exact_dedup(docs).where("kept").select(F.coalesce("keep_id", F.lit(0)).alias("__q_id"), F.col("keep_id").isNull().alias("__q_no"), F.col("text_sha256").alias("__q_sha"))
    rows = docs.withColumn("__q_id", F.coalesce("doc_id", F.lit(0))).withColumn("__q_no", F.col("doc_id").isNull()).withColumn("__q_sha", F.sha2(lower_ascii(F.col("text")), 256))
    return rows.join(marks, ["__q_id", "__q_no", "__q_sha"], "left_semi").dropDuplicates(["__q_id", "__q_no", "__q_sha"]).select(*docs.columns)
