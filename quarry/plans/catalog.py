"""Registered queries (Spark) and their independent DuckDB oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame``; ``ORACLE[name]`` is ANSI SQL over
the driver tables registered as views.  Scores are rounded to 6 decimals and
decimals are returned as doubles on both sides so values hash identically.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.registry import ORACLE, QUERIES, register
from quarry.plans.sql_fragments import VECTOR_INDEX_SQL

__all__ = ["ORACLE", "QUERIES", "register"]


# --- retrieval ---------------------------------------------------------------------
@register("vector_topk", f"""
WITH idx AS ({VECTOR_INDEX_SQL}),
scored AS (
    SELECT q.vec_id AS query_id, i.source_path, i.chunk_index, i.content,
           list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])) AS sim
    FROM embeddings q, idx i
    WHERE i.embedding IS NOT NULL
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, source_path, chunk_index) AS rn
    FROM scored WHERE sim IS NOT NULL AND NOT isnan(sim)
)
SELECT query_id, CAST(rn AS INTEGER) AS rank, source_path, chunk_index, content,
       round(sim, 6) AS similarity
FROM ranked WHERE rn <= 5
""")
def q_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.operators.vector_search import vector_topk
    from quarry.plans import fixtures as fx
    out = vector_topk(fx.vector_index(spark, sf_dir), fx.vector_queries(spark, sf_dir), k=5)
    return out.withColumn("similarity", F.round("similarity", 6))


# Area modules register their queries on import.
from quarry.plans import q_accounting, q_bank, q_index, q_more, q_plan, q_quality, q_retrieval, q_sessions, q_streams  # noqa: E402,F401
