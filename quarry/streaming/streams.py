"""Structured Streaming forms of the per-event writes (OP-X1..X5, OP-D5).

The reference writes one row per event in its own transaction and refreshes the index by
polling; here the same rules run incrementally, over files in any order, and no row is ever late.

* X1 ``index_refresh``: new Markdown files -> chunks, a refresh of the versioned index an epoch.
* X2, X3 ``fold_sink``: an epoch appends its own partial result (sums an hour, first answer a key), and
  every few epochs the partial results so far are folded into one.  There is no state to age
  out: a late row is one more partial result, merged when it is read.
* X4, X5, D5 ``session_stream``: keyed state on disk (``difficulty.SessionRows``); an epoch reads its own
  rows and emits the answers, or counters, that they change.  ``newest`` reads the last row of every key.

A replayed epoch overwrites its own folder only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.accounting import usage_cost
from quarry.operators.versions import refresh_index
from quarry.session import checkpoint_dir
from quarry.streaming.difficulty import GROUP, SessionRows

ANSWER_KEYS = ["session_id", "question_number"]
DIFFICULTY_SCHEMA = ("session_id long, question_number int, is_correct boolean, "
                     "assigned_difficulty int, next_difficulty int")
COUNTERS_SCHEMA = "session_id long, answered_questions long, correct_answers long"
#: Epochs of a fold sink that are folded into one.
FOLD_EPOCHS = 16
#: Keyed state lives on disk, not in the executors' heaps.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def usage_hourly(log: DataFrame, pricing: DataFrame) -> DataFrame:
    """Sums an hour of one epoch's responses."""
    u = usage_cost(log, pricing)
    hour = F.date_trunc("hour", "created_at").cast(u.schema["created_at"].dataType)
    return merge_hours(u.select(hour.alias("time"), F.col("total_cost_usd").cast("decimal(38,10)").alias("cost_usd"), "input_tokens", "output_tokens"))


def merge_hours(partial: DataFrame) -> DataFrame:
    return partial.groupBy("time").agg(*[F.sum(c).cast(partial.schema[c].dataType).alias(c) for c in ("cost_usd", "input_tokens", "output_tokens")])


def folded(spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The merged partial results of a fold sink: its last base and the epochs after it."""
    return merge(_since_base(spark, path).drop("epoch", "kind"))


def _since_base(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.parquet(path)
    base = parts.where(F.col("kind") == "base").agg(F.max("epoch")).first()[0]
    if base is None:
        return parts.where(F.col("kind") == "delta")
    return parts.where(((F.col("kind") == "base") & (F.col("epoch") == base)) | ((F.col("kind") == "delta") & (F.col("epoch") > base)))


def fold_sink(path: str, partial: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], every: int = FOLD_EPOCHS):
    """``foreachBatch`` handler: appends the epoch's partial result; every ``every`` epochs the sink is folded."""
    def handle(batch: DataFrame, epoch: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}/kind=delta")
        if (epoch + 1) % every == 0:
            spark = batch.sparkSession
            merged = folded(spark, path, merge)
            merged.write.mode("overwrite").parquet(f"{path}/epoch={epoch}/kind=base")
    return handle


def start_fold(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """An empty fold sink of a known schema, so that a stream without rows reads as empty."""
    spark.createDataFrame([], schema).write.parquet(f"{path}/epoch=-1/kind=delta")


def session_stream(answers: DataFrame, order_cols: list[str], emit: str) -> DataFrame:
    """Changed difficulties ("path") or counters ("counters") of the sessions that an epoch's answers touch."""
    schema = DIFFICULTY_SCHEMA if emit == "path" else COUNTERS_SCHEMA
    # Each order column as a flag and a value that is never null.
    order = {}
    for i, c in enumerate(order_cols):
        kind = answers.schema[c].dataType
        none = F.lit(0) if isinstance(kind, T.NumericType) else F.lit("") if isinstance(kind, T.StringType) else F.lit("1970-01-01")
        order |= {f"given{i}": F.col(c).isNotNull(), f"order{i}": F.coalesce(F.col(c), none.cast(kind))}
    rows = answers.select("session_id", "question_number", "is_correct", *[v.alias(k) for k, v in order.items()])
    return rows.withColumn("sessions", F.floor(F.col("session_id") / GROUP)).groupBy("sessions").transformWithState(SessionRows(tuple(order), emit), schema, "update", "none")


def start_sink(spark: SparkSession, path: str, schema: str | T.StructType) -> str:
    """An empty sink of a known schema, so that a stream without rows reads as empty."""
    spark.createDataFrame([], schema).write.parquet(f"{path}/epoch=-1")
    return path


def append_epoch(batch: DataFrame, path: str, epoch: int) -> None:
    batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def newest(df: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the last epoch per key (``max_by`` combines map-side)."""
    rest = [c for c in df.columns if c not in (*keys, "epoch")]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def index_refresh(root: str, build_rows: Callable[[DataFrame], DataFrame]):
    """``foreachBatch`` handler: an epoch of changed files replaces its sources in the index at ``root``.  The
    files are read once; an epoch that was committed before is not written again."""
    def handle(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            refresh_index(root, batch, build_rows, tag=f"epoch-{epoch}")
        finally:
            batch.unpersist()
    return handle


def stream_root(spark: SparkSession, name: str) -> str:
    """A new folder for one run of a stream under the shared ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:8]}"


def run_available_now(stream: DataFrame, root: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Run a stream in update mode over what is available now; its checkpoint is kept in ``root``."""
    conf = stream.sparkSession.conf
    before = {k: conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        conf.set(k, v)
    try:
        (stream.writeStream.outputMode("update").option("checkpointLocation", f"{root}/_checkpoint")
         .foreachBatch(handle).trigger(availableNow=True).start().awaitTermination())
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
