"""Hybrid retrieval: vector + lexical candidate lists fused by reciprocal rank (OP-R8, OP-R9,
OP-J2, OP-A1, OP-U1, OP-W1..W3, OP-T2, OP-T3).

Fixed values from the reference: RRF constant 60; each candidate list keeps
max(4 k, 20) rows; the fused list keeps k rows.  Ties everywhere are broken
by (source_path, chunk_index) so every rank is a total order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.blockmax import BlockIndex, lexical_topk_blocks
from quarry.operators.lexical import build_postings, lexical_topk, prepared_terms
from quarry.operators.vector_search import vector_topk
from quarry.session import bounded, cut_lineage

RRF_K = 60
CANDIDATE_MULTIPLIER = 4
MIN_CANDIDATES = 20


def candidate_limit(k: int) -> int:
    return max(k * CANDIDATE_MULTIPLIER, MIN_CANDIDATES)


def check_k(k) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or k <= 0:
        raise ValueError("num_results must be a positive integer")
    return k


def hybrid_search(index: DataFrame, queries: DataFrame, k: int = 5, *,
                  key_cols: Sequence[str] = ("source_path", "chunk_index"),
                  content_col: str = "content", vector_col: str = "embedding",
                  query_id: str = "query_id", query_text: str = "query",
                  query_vector: str = "embedding", index_postings: DataFrame | None = None,
                  block_index: BlockIndex | None = None, rrf_k: int = RRF_K, limit_col: str | None = None) -> DataFrame:
    """Top-k fused results per query; ``limit_col`` names a per-query limit (1 to k) in ``queries``,
    which sets that query's candidate lists too.  With a stored ``block_index`` the lexical list
    comes from it.

    Output: query_id, source_path, chunk_index, content, vector_similarity,
    lexical_score, vector_rank, lexical_rank, hybrid_score, hybrid_rank.
    Scores / ranks of a list that missed the chunk are null.
    """
    check_k(k)
    keys = list(key_cols)
    cand = candidate_limit(k)
    limits = None
    if limit_col is not None:
        own = F.greatest(F.col(limit_col) * CANDIDATE_MULTIPLIER, F.lit(MIN_CANDIDATES)).cast("int")
        queries = cut_lineage(queries.withColumn("_cand", own))
        limits = bounded(queries.select(query_id, F.col(limit_col).alias("_limit"), "_cand"))
    vec = (vector_topk(index, queries, cand, limit_col=None if limits is None else "_cand", key_cols=keys, payload_cols=(content_col,),
                       vector_col=vector_col, query_id=query_id, query_vector=query_vector)
           .select(query_id, *keys, content_col, F.col("similarity").alias("vector_similarity"),
                   F.col("rank").cast("long").alias("vector_rank")))
    if block_index is not None:
        lex, _ = lexical_topk_blocks(block_index, queries, cand, query_id, query_text)
    else:
        terms, n_terms = prepared_terms(queries.select(query_id, query_text), query_id, query_text)
        # The postings are the inverted index: built once and reused by every lexical step below.
        post = index_postings if index_postings is not None else build_postings(index, keys, content_col)
        lex = lexical_topk(post, terms, cand, keys, query_id, n_terms, index.select(*keys))
    if limits is not None:
        lex = lex.join(limits, query_id).where(F.col("lexical_rank") <= F.col("_cand")).drop("_limit", "_cand")
    # At most n_queries * cand rows: measured, then broadcast against a pruned re-scan of the index.
    lex = index.select(*keys, content_col).join(bounded(lex), keys)
    typed_null = lambda t: F.lit(None).cast(t)
    ranked = (vec.select(query_id, *keys, content_col, "vector_similarity", "vector_rank",
                         typed_null("double").alias("lexical_score"), typed_null("long").alias("lexical_rank"),
                         (F.lit(1.0) / (F.lit(float(rrf_k)) + F.col("vector_rank"))).alias("rrf"))
              .unionByName(lex.select(query_id, *keys, content_col,
                                      typed_null("double").alias("vector_similarity"),
                                      typed_null("long").alias("vector_rank"), "lexical_score", "lexical_rank",
                                      (F.lit(1.0) / (F.lit(float(rrf_k)) + F.col("lexical_rank"))).alias("rrf"))))
    fused = (ranked.groupBy(query_id, *keys, content_col)
             .agg(F.max("vector_similarity").alias("vector_similarity"),
                  F.max("lexical_score").alias("lexical_score"),
                  F.max("vector_rank").alias("vector_rank"),
                  F.max("lexical_rank").alias("lexical_rank"),
                  F.sum("rrf").alias("hybrid_score")))
    w = Window.partitionBy(query_id).orderBy(F.col("hybrid_score").desc(), *[F.col(c).asc() for c in keys])
    top = fused.withColumn("hybrid_rank", F.row_number().over(w).cast("long")).where(F.col("hybrid_rank") <= k)
    if limits is None:
        return top
    return top.join(limits, query_id).where(F.col("hybrid_rank") <= F.col("_limit")).drop("_limit", "_cand")


def search(index: DataFrame, queries: DataFrame, k: int = 5, mode: str = "hybrid", **kw) -> DataFrame:
    """Mode dispatch (OP-R10): 'hybrid' or 'vector'."""
    if mode == "hybrid":
        return hybrid_search(index, queries, k, **kw)
    if mode == "vector":
        check_k(k)
        keys = list(kw.get("key_cols", ("source_path", "chunk_index")))
        return vector_topk(index, queries, k, key_cols=keys,
                           payload_cols=(kw.get("content_col", "content"),),
                           vector_col=kw.get("vector_col", "embedding"),
                           query_id=kw.get("query_id", "query_id"),
                           query_vector=kw.get("query_vector", "embedding"))
    raise ValueError("search_mode must be 'hybrid' or 'vector'")
