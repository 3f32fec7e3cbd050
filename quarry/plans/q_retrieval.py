"""Registered lexical, embedding and hybrid retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import hybrid as hy
from quarry.operators import lexical as lx
from quarry.operators.embedding import embed_hashing
from quarry.plans import fixtures as fx
from quarry.plans.registry import register
from quarry.plans.sql_fragments import (
    LINE_INDEX_SQL, SEARCH_QUERIES_SQL, VECTOR_INDEX_SQL, bucket_counts_sql, lexical_sql, postings_sql, query_terms_sql,
)

LEX_CTE = lexical_sql(postings_sql("SELECT * FROM idx"), query_terms_sql("SELECT * FROM q"))
HEAD = f"WITH idx AS ({LINE_INDEX_SQL}), q AS ({SEARCH_QUERIES_SQL}),"


@register("postings", f"SELECT * FROM ({postings_sql(LINE_INDEX_SQL)})")
def q_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lx.postings(fx.line_index(spark, sf_dir))


@register("query_terms", f"SELECT * FROM ({query_terms_sql(SEARCH_QUERIES_SQL)})")
def q_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lx.query_terms(fx.search_queries(spark, sf_dir))


@register("lexical_match", f"{HEAD} {LEX_CTE} SELECT * FROM matched_")
def q_lexical_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, n = lx.prepared_terms(fx.search_queries(spark, sf_dir))
    return lx.lexical_match(lx.build_postings(fx.line_index(spark, sf_dir)), terms, term_rows=n)


@register("cover_density", f"""{HEAD} {LEX_CTE}
SELECT query_id, source_path, chunk_index, round(lexical_score, 6) AS lexical_score FROM scored_""")
def q_cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, n = lx.prepared_terms(fx.search_queries(spark, sf_dir))
    post = lx.build_postings(fx.line_index(spark, sf_dir))
    matched = lx.lexical_match(post, terms, term_rows=n, scored=True)
    return (lx.cover_density(post, terms, matched, term_rows=n)
            .withColumn("lexical_score", F.round("lexical_score", 6)))


@register("embed_chunks", f"""
WITH idx AS ({LINE_INDEX_SQL}),
cb AS ({bucket_counts_sql("SELECT * FROM idx", "source_path, chunk_index", "content")})
SELECT i.source_path, i.chunk_index,
       list_transform(range(384), lambda j: CAST(coalesce(m[j], 0) AS FLOAT)) AS embedding
FROM idx i LEFT JOIN (SELECT source_path, chunk_index, map(list(b), list(c)) AS m FROM cb GROUP BY ALL) x
     USING (source_path, chunk_index)
""")
def q_embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_hashing(fx.line_index(spark, sf_dir), "content").select("source_path", "chunk_index", "embedding")


# idx (chunks), q (query_id, query), lim (query_id, candidates of a list, results) -> final.
HYBRID_CTES = f"""{LEX_CTE},
cb AS ({bucket_counts_sql("SELECT * FROM idx", "source_path, chunk_index", "content")}),
qb AS ({bucket_counts_sql("SELECT * FROM q", "query_id", "query")}),
cn AS (SELECT source_path, chunk_index, sqrt(sum(c * c)) AS n FROM cb GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(c * c)) AS n FROM qb GROUP BY ALL),
vsim AS (
    SELECT qb.query_id, cb.source_path, cb.chunk_index,
           sum(qb.c * cb.c) / (any_value(qn.n) * any_value(cn.n)) AS sim
    FROM qb JOIN cb USING (b) JOIN qn USING (query_id) JOIN cn USING (source_path, chunk_index)
    GROUP BY ALL),
vec AS (
    SELECT * FROM (
        SELECT query_id, source_path, chunk_index, sim AS vector_similarity,
               row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, source_path, chunk_index) AS vector_rank
        FROM vsim) JOIN lim USING (query_id) WHERE vector_rank <= cand),
lex AS (
    SELECT * FROM (
        SELECT query_id, source_path, chunk_index, lexical_score,
               row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, source_path, chunk_index)
                 AS lexical_rank
        FROM scored_) JOIN lim USING (query_id) WHERE lexical_rank <= cand),
ranked AS (
    SELECT query_id, source_path, chunk_index, vector_similarity, vector_rank,
           CAST(NULL AS DOUBLE) AS lexical_score, CAST(NULL AS BIGINT) AS lexical_rank,
           CAST(1 AS DOUBLE) / (60 + vector_rank) AS rrf FROM vec
    UNION ALL
    SELECT query_id, source_path, chunk_index, CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT), lexical_score,
           lexical_rank, CAST(1 AS DOUBLE) / (60 + lexical_rank) FROM lex),
fused AS (
    SELECT query_id, source_path, chunk_index, max(vector_similarity) AS vector_similarity,
           max(lexical_score) AS lexical_score, max(vector_rank) AS vector_rank,
           max(lexical_rank) AS lexical_rank, sum(rrf) AS hybrid_score
    FROM ranked GROUP BY ALL),
final AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, source_path, chunk_index)
                AS hybrid_rank
    FROM fused)
"""

HYBRID_SQL = f"""{HEAD} lim AS (SELECT query_id, 20 AS cand, 5 AS k FROM q), {HYBRID_CTES}
SELECT f.query_id, f.source_path, f.chunk_index, i.content, round(f.vector_similarity, 6) AS vector_similarity,
       round(f.lexical_score, 6) AS lexical_score, f.vector_rank, f.lexical_rank,
       round(f.hybrid_score, 6) AS hybrid_score, f.hybrid_rank
FROM final f JOIN idx i USING (source_path, chunk_index) JOIN lim USING (query_id)
WHERE f.hybrid_rank <= lim.k
"""

SCORES = ("vector_similarity", "lexical_score", "hybrid_score")


def rounded(df: DataFrame, cols=SCORES) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("hybrid_search", HYBRID_SQL)
def q_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Line chunks feed scoring, postings and both payload joins; a vector is made for scoring alone and never kept.
    index = fx.hybrid_index(spark, sf_dir)
    out = hy.hybrid_search(index, fx.hybrid_queries(spark, sf_dir), k=5)
    return rounded(out.select("query_id", "source_path", "chunk_index", "content", *SCORES[:2],
                              "vector_rank", "lexical_rank", "hybrid_score", "hybrid_rank"))


# 16 bands of 6 planes; a query also looks where either of its two least certain bits is flipped.
LSH_CTES = f"""
WITH idx AS (SELECT source_path, chunk_index, embedding FROM ({VECTOR_INDEX_SQL}) WHERE embedding IS NOT NULL),
plane AS (
    SELECT p, list(CASE WHEN md5('17|' || p || '|' || j) >= '8' THEN 1::DOUBLE ELSE -1::DOUBLE END ORDER BY j) AS signs
    FROM (SELECT unnest(range(96)) AS p), (SELECT unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS j) GROUP BY p),
side AS (
    SELECT vec_id, p // 6 AS band, p % 6 AS bit, list_dot_product(CAST(embedding AS DOUBLE[]), signs) AS s FROM embeddings, plane),
sig AS (SELECT vec_id, band, sum(CASE WHEN s > 0 THEN 1 << bit ELSE 0 END) AS sig FROM side GROUP BY ALL),
flip AS (
    SELECT vec_id, band, 1 << bit AS mask FROM side QUALIFY row_number() OVER (PARTITION BY vec_id, band ORDER BY s * s, bit) <= 2
    UNION ALL SELECT vec_id, band, 0 FROM sig),
item AS (SELECT source_path, chunk_index, band, sig FROM ({VECTOR_INDEX_SQL.replace("e.embedding", "e.embedding, e.vec_id")}) JOIN sig USING (vec_id)),
cand AS (
    SELECT DISTINCT f.vec_id AS query_id, i.source_path, i.chunk_index
    FROM flip f JOIN sig s ON f.vec_id = s.vec_id AND f.band = s.band
         JOIN item i ON i.band = f.band AND i.sig = xor(CAST(s.sig AS BIGINT), CAST(f.mask AS BIGINT))),
scored AS (
    SELECT query_id, source_path, chunk_index, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])) AS sim
    FROM cand JOIN embeddings q ON q.vec_id = query_id JOIN idx i USING (source_path, chunk_index)),
near AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, source_path, chunk_index) AS INTEGER) AS rank
    FROM scored QUALIFY rank <= 5)
"""


@register("vector_topk_lsh", f"{LSH_CTES} SELECT query_id, rank, source_path, chunk_index, round(sim, 6) AS similarity FROM near")
def q_vector_topk_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate top-5 with sign-random-projection bands, re-ranked exactly."""
    from quarry.operators.vector_search import vector_topk_lsh
    out = vector_topk_lsh(fx.vector_index(spark, sf_dir), fx.vector_queries(spark, sf_dir), 5)
    return out.withColumn("similarity", F.round("similarity", 6))


@register("lsh_recall", f"""{LSH_CTES},
exact AS (
    SELECT q.vec_id AS query_id, source_path, chunk_index FROM embeddings q, idx i
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])) DESC,
                                                             source_path, chunk_index) <= 5)
SELECT count(*) AS exact_rows, count(n.rank) AS found, count(n.rank) / count(*) AS recall
FROM exact e LEFT JOIN near n USING (query_id, source_path, chunk_index)""")
def q_lsh_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall@5 of the LSH search against the exact search over the same tables."""
    from quarry.operators.vector_search import recall_at_k, vector_topk, vector_topk_lsh
    idx, qs = fx.vector_index(spark, sf_dir), fx.vector_queries(spark, sf_dir)
    exact = vector_topk(idx, qs, 5, payload_cols=())
    approx = vector_topk_lsh(idx, qs, 5)
    return recall_at_k(approx, exact, "query_id", ["source_path", "chunk_index"])


VARIANTS_SQL = """
    SELECT item_id * 10 + 1 AS query_id, '"' || replace(text, '"', '') || '"' AS query FROM benchmark
    UNION ALL
    SELECT item_id * 10 + 2 AS query_id, replace(text, ',', ' or ') AS query FROM benchmark
"""
VARIANT_CTE = lexical_sql(postings_sql("SELECT * FROM idx"), query_terms_sql("SELECT * FROM q"))


@register("lexical_syntax", f"""WITH idx AS ({LINE_INDEX_SQL}), q AS ({VARIANTS_SQL}), {VARIANT_CTE}
SELECT query_id, source_path, chunk_index, round(lexical_score, 6) AS lexical_score FROM scored_""")
def q_lexical_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase and OR forms of every benchmark passage: match + cover density."""
    terms, n = lx.prepared_terms(fx.search_query_variants(spark, sf_dir))
    post = lx.build_postings(fx.line_index(spark, sf_dir))
    matched = lx.lexical_match(post, terms, term_rows=n, scored=True)
    return (lx.cover_density(post, terms, matched, term_rows=n)
            .withColumn("lexical_score", F.round("lexical_score", 6)))
