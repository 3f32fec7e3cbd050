"""Registered streaming jobs: each runs to completion over the driver tables used as a file
stream (trigger availableNow) and returns what its sink holds, which must equal the batch
job's result (the oracle SQL is the batch queries')."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import versions
from quarry.operators.accounting import pricing_table
from quarry.operators.chunking import chunk_markdown
from quarry.operators.sessions import answers_first_wins
from quarry.plans import fixtures as fx
from quarry.plans.registry import ORACLE, register
from quarry.plans.sql_fragments import ANSWERS_SQL, USAGE_SQL
from quarry.plans import q_index, q_sessions  # noqa: F401  (their oracle SQL is reused)
from quarry.sources.tables import table
from quarry.streaming import streams as st

FIRST_ANSWER_COLS = ["session_id", "question_number", "is_correct", "answered_at"]


def file_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, one file a trigger.  The glob matches a single file as well as a
    folder of part files (a plain path would have to be a folder)."""
    schema = table(spark, sf_dir, name).schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]"))


def _upserts(stream: DataFrame, name: str, schema: str, keys: list[str]) -> DataFrame:
    spark = stream.sparkSession
    root = st.stream_root(spark, name)
    out = st.start_sink(spark, f"{root}/out", schema)
    st.run_available_now(stream, root, lambda batch, epoch: st.append_epoch(batch, out, epoch))
    return st.newest(spark.read.parquet(out), keys)


def _folded(stream: DataFrame, name: str, partial, merge) -> DataFrame:
    spark = stream.sparkSession
    root = st.stream_root(spark, name)
    st.start_fold(spark, f"{root}/out", partial(spark.createDataFrame([], stream.schema)).schema)
    st.run_available_now(stream, root, st.fold_sink(f"{root}/out", partial, merge))
    return st.folded(spark, f"{root}/out", merge)


@register("stream_usage_hourly", f"""
SELECT date_trunc('hour', created_at) AS time, CAST(sum(total_cost_usd) AS DOUBLE) AS cost_usd,
       sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens
FROM ({USAGE_SQL}) GROUP BY 1
""")
def q_stream_usage_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = pricing_table(spark, fx.PRICING_JSON)
    out = _folded(fx.usage_rows(file_stream(spark, sf_dir, "events")), "usage_hourly", lambda batch: st.usage_hourly(batch, prices), st.merge_hours)
    return out.withColumn("cost_usd", F.col("cost_usd").cast("double"))


@register("stream_first_answers", f"SELECT {', '.join(FIRST_ANSWER_COLS)} FROM ({ANSWERS_SQL})")
def q_stream_first_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    def first(rows: DataFrame) -> DataFrame:
        return answers_first_wins(rows, fx.ANSWER_ORDER)
    out = _folded(fx.answer_rows(file_stream(spark, sf_dir, "lineitem")), "first_answers", first, first)
    return out.select(*FIRST_ANSWER_COLS)


def _sessions(spark: SparkSession, sf_dir: str, emit: str) -> DataFrame:
    rows = fx.answer_rows(file_stream(spark, sf_dir, "lineitem")).select("session_id", "question_number", "is_correct", *fx.ANSWER_ORDER)
    return st.session_stream(rows, fx.ANSWER_ORDER, emit)


@register("stream_difficulty", ORACLE["difficulty_path"])
def q_stream_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserts(_sessions(spark, sf_dir, "path"), "difficulty", st.DIFFICULTY_SCHEMA, st.ANSWER_KEYS)


@register("stream_session_counters", ORACLE["session_counters"])
def q_stream_session_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserts(_sessions(spark, sf_dir, "counters"), "counters", st.COUNTERS_SCHEMA, ["session_id"])


@register("stream_index_refresh", ORACLE["chunk_markdown"])
def q_stream_index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arriving as a file stream are chunked and replace their source in the index."""
    root = st.stream_root(spark, "index")
    versions.create_index(root, fx.existing_index(spark, sf_dir))
    files = fx.markdown_rows(file_stream(spark, sf_dir, "documents"))
    st.run_available_now(files, root, st.index_refresh(root, chunk_markdown))
    return versions.read_index(spark, root)
