"""Multi-topic retrieval for whole tables of sessions (OP-R10..R12, OP-U2, OP-A14, OP-P3, OP-P4, OP-P5).

A session lists topics; each topic is searched with its share of the
session's result budget, and the hits are merged by chunk identity keeping
the first topic's scores and every matched topic in first-seen order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.hybrid import hybrid_search
from quarry.operators.vector_search import vector_topk

IDENTITY = ("source_path", "chunk_index", "content")


def explode_topics(sessions: DataFrame, session_col: str = "session_id", topics_col: str = "topics") -> DataFrame:
    """One row per (session, topic) with the topic's position (topics already normalised)."""
    return sessions.select(session_col, F.posexplode(topics_col).alias("topic_pos", "topic"),
                           F.size(topics_col).alias("n_topics"), *[c for c in sessions.columns
                                                                    if c not in (session_col, topics_col)])


def topic_budget(topics: DataFrame, total_col: str | None, default_k: int) -> Column:
    """Results per topic: ``n // T + (i < n % T)`` when a total is given, else ``default_k`` each."""
    if total_col is None:
        return F.lit(default_k)
    n, t, i = F.col(total_col), F.col("n_topics"), F.col("topic_pos")
    return (F.floor(n / t) + F.when(i < F.pmod(n, t), 1).otherwise(0)).cast("int")


def merge_by_identity(hits: DataFrame, session_col: str = "session_id",
                      score_cols: Sequence[str] = ("similarity",),
                      identity: Sequence[str] = IDENTITY) -> DataFrame:
    """Merge per-topic hits: first-seen order, first topic's scores, matched topics in order.

    ``hits``: session, topic_pos, topic, rank, identity columns, scores.
    """
    ident = list(identity)
    first = F.struct("topic_pos", "rank")
    merged = (hits.groupBy(session_col, *ident)
              .agg(F.min(first).alias("_first"),
                   F.min_by(F.struct(*score_cols), first).alias("_scores"),
                   F.array_sort(F.collect_list(F.struct("topic_pos", "topic"))).alias("_topics")))
    return merged.select(session_col, *ident, *[F.col(f"_scores.{c}").alias(c) for c in score_cols],
                         F.transform("_topics", lambda x: x["topic"]).alias("matched_topics"),
                         F.col("_first.topic_pos").alias("first_topic_pos"), F.col("_first.rank").alias("first_rank"))


def multi_topic_retrieve(index: DataFrame, sessions: DataFrame, *, default_k: int = 5,
                         total_col: str | None = None, session_col: str = "session_id",
                         topics_col: str = "topics", topic_vector_fn=None, mode: str = "vector") -> DataFrame:
    """Retrieval of every (session, topic) with its budget, then merge.  ``mode`` 'hybrid' fuses the
    vector and the lexical list of each topic, 'vector' ranks by similarity alone.

    ``topic_vector_fn(df, text_col) -> df with 'embedding'`` embeds topic text.
    Output: session, identity, scores (similarity; in hybrid mode vector_similarity, lexical_score,
    hybrid_score), matched_topics, first_topic_pos, first_rank, order.
    """
    t = explode_topics(sessions, session_col, topics_col)
    t = t.withColumn("topic_limit", topic_budget(t, total_col, default_k)).where(F.col("topic_limit") > 0)
    t = t.withColumn("query_id", F.concat_ws(":", session_col, "topic_pos"))  # no two topics share it
    q = topic_vector_fn(t, "topic") if topic_vector_fn else t
    kmax = default_k if total_col is None else None
    if kmax is None:
        row = t.agg(F.max("topic_limit").alias("m")).head()
        kmax = int(row["m"] or 1)
    if mode == "hybrid":
        hits = (hybrid_search(index, q.select("query_id", "topic", "embedding", "topic_limit"), kmax,
                              query_text="topic", limit_col="topic_limit").withColumnRenamed("hybrid_rank", "rank"))
        scores = ("vector_similarity", "lexical_score", "hybrid_score")
    elif mode == "vector":
        hits = vector_topk(index, q.select("query_id", "embedding", "topic_limit"), kmax,
                           payload_cols=("content",), limit_col="topic_limit")
        scores = ("similarity",)
    else:
        raise ValueError("search_mode must be 'hybrid' or 'vector'")
    # Topic rows are as many as (sessions x topics): bounded by the session table, broadcast when small.
    hits = hits.join(t.select("query_id", session_col, "topic_pos", "topic"), "query_id")
    merged = merge_by_identity(hits, session_col, scores)
    w = Window.partitionBy(session_col).orderBy("first_topic_pos", "first_rank")
    return merged.withColumn("order", F.row_number().over(w).cast("int"))


def unique_chunks(retrieved: DataFrame, session_col: str = "session_id", order_col: str = "order",
                  identity: Sequence[str] = IDENTITY) -> DataFrame:
    """First row per chunk identity, in retrieval order, renumbered from 0."""
    w = Window.partitionBy(session_col, *identity).orderBy(order_col)
    first = retrieved.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    wp = Window.partitionBy(session_col).orderBy(order_col)
    return first.withColumn("chunk_pos", (F.row_number().over(wp) - 1).cast("int"))


def context_block(topics: Column, source_path: Column, content: Column) -> Column:
    """``Topics: a, b\\nSource: path\\ncontent`` for one chunk."""
    return F.concat(F.lit("Topics: "), F.array_join(F.coalesce(topics, F.array().cast("array<string>")), ", "),
                    F.lit("\nSource: "), F.coalesce(source_path, F.lit("unknown")), F.lit("\n"),
                    F.coalesce(content, F.lit("")))


def context_assembly(chunks: DataFrame, session_col: str = "session_id", order_col: str = "order") -> DataFrame:
    """Per session: context blocks in order joined by a blank line (a session's retrieval
    result is bounded by its result budget, so the ordered collect is bounded too)."""
    blocks = chunks.select(session_col, order_col,
                           context_block(F.col("matched_topics"), F.col("source_path"), F.col("content")).alias("b"))
    return (blocks.groupBy(session_col)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order_col, "b"))),
                                          lambda x: x["b"]), "\n\n").alias("context")))


def fill_template(template: str, **cols: Column) -> Column:
    """Row-wise template fill: ``{name}`` placeholders replaced by column values."""
    parts: list[Column] = []
    rest = template
    while rest:
        start = rest.find("{")
        end = rest.find("}", start + 1) if start >= 0 else -1
        if start < 0 or end < 0:
            parts.append(F.lit(rest))
            break
        if start:
            parts.append(F.lit(rest[:start]))
        name = rest[start + 1:end]
        parts.append(F.coalesce(cols[name].cast("string"), F.lit("")) if name in cols else F.lit("{" + name + "}"))
        rest = rest[end + 1:]
    return F.concat(*parts) if parts else F.lit("")
