"""Registered question-bank queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import bank as bk
from quarry.plans import fixtures as fx
from quarry.plans.registry import register
from quarry.plans.sql_fragments import DOC_PATH_SQL, bucket_counts_sql

T = fx.BANK_THRESHOLD

# rec: every record with its vector v (counts of hashed tokens, as DOUBLE[384]) and the vector's length n.
RECORDS_CTE = f"""
b_ AS ({bucket_counts_sql("SELECT doc_id, text FROM documents", "doc_id", "text")}),
m_ AS (SELECT doc_id, map(list(b), list(c)) AS m, sqrt(CAST(sum(c * c) AS DOUBLE)) AS n FROM b_ GROUP BY doc_id),
rec AS MATERIALIZED (
    SELECT doc_id AS candidate_id, d.text AS question_text, m_.n,
           list_transform(range(384), lambda j: CAST(coalesce(m_.m[j], 0) AS DOUBLE)) AS v,
           ['short_answer', 'single_choice', 'multiple_choice'][(doc_id % 3) + 1] AS question_type,
           CAST(doc_id % 5 + 1 AS INTEGER) AS difficulty, {DOC_PATH_SQL} AS path, d.source, d.lang,
           doc_id IN (SELECT doc_id FROM labels) AS in_bank
    FROM documents d LEFT JOIN m_ USING (doc_id))"""

NEAREST_CTE = f"""{RECORDS_CTE},
near AS MATERIALIZED (
    SELECT c.candidate_id, max(list_inner_product(c.v, b.v) / (c.n * b.n)) AS best_similarity
    FROM rec c LEFT JOIN rec b ON b.in_bank AND b.n IS NOT NULL AND c.n IS NOT NULL
    WHERE NOT c.in_bank GROUP BY c.candidate_id)"""

STORE_CTE = f"""{NEAREST_CTE},
fresh AS MATERIALIZED (
    SELECT c.candidate_id, c.v, c.n, row_number() OVER (ORDER BY c.candidate_id) AS step
    FROM rec c JOIN near USING (candidate_id)
    WHERE NOT c.in_bank AND NOT coalesce(near.best_similarity >= {T}, false)),
edges AS MATERIALIZED (
    SELECT a.step AS i, b.step AS j FROM fresh a JOIN fresh b ON a.step < b.step
    WHERE list_inner_product(a.v, b.v) / (a.n * b.n) >= {T}),
walk(step, kept) AS (
    SELECT 0, CAST([] AS BIGINT[])
    UNION ALL
    SELECT w.step + 1,
           CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.j = w.step + 1 AND list_contains(w.kept, e.i))
                THEN w.kept ELSE list_append(w.kept, w.step + 1) END
    FROM walk w WHERE w.step < (SELECT count(*) FROM fresh)),
kept AS (SELECT unnest(kept) AS step FROM walk WHERE step = (SELECT count(*) FROM fresh)),
verdicts AS (
    SELECT near.candidate_id,
           CASE WHEN f.step IN (SELECT step FROM kept) THEN 'inserted' ELSE 'skipped' END AS verdict,
           CASE WHEN coalesce(near.best_similarity >= {T}, false) THEN 'bank'
                WHEN f.step NOT IN (SELECT step FROM kept) THEN 'batch' END AS reason,
           round(near.best_similarity, 6) AS best_bank_similarity
    FROM near LEFT JOIN fresh f USING (candidate_id))"""


@register("bank_nearest", f"""WITH {NEAREST_CTE}
SELECT candidate_id, round(best_similarity, 6) AS best_similarity,
       coalesce(best_similarity >= {T}, false) AS is_duplicate
FROM near
""")
def q_bank_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bk.bank_nearest(fx.bank_batch(spark, sf_dir), fx.question_bank(spark, sf_dir), T)
    return out.withColumn("best_similarity", F.round("best_similarity", 6))


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = bk.normalize_records(fx.bank_batch(spark, sf_dir))
    bk.check_batch(batch)
    return bk.bank_store(batch, fx.question_bank(spark, sf_dir), T)


@register("bank_store", f"WITH RECURSIVE {STORE_CTE} SELECT * FROM verdicts")
def q_bank_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).select("candidate_id", "verdict", "reason",
                                        F.round("best_bank_similarity", 6).alias("best_bank_similarity"))


@register("bank_store_stats", f"""WITH RECURSIVE {STORE_CTE}
SELECT count(*) FILTER (WHERE verdict = 'inserted') AS inserted,
       count(*) FILTER (WHERE verdict = 'skipped') AS skipped FROM verdicts
""")
def q_bank_store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bk.bank_store_stats(_store(spark, sf_dir))


BANK_CTE = f"""{RECORDS_CTE},
bank AS (
    SELECT candidate_id AS id, question_type, regexp_replace(question_text, '^\\s+|\\s+$', '', 'g') AS question_text,
           CASE WHEN question_type = 'short_answer' THEN [] ELSE [source, lang, concat_ws('-', source, lang)] END AS options,
           CASE question_type WHEN 'short_answer' THEN [lang] WHEN 'single_choice' THEN [source]
                ELSE [source, lang] END AS correct_answer,
           'from ' || source AS explanation, [path] AS source_paths, difficulty,
           TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(candidate_id AS INTEGER)) AS created_at
    FROM rec WHERE in_bank)"""


@register("bank_list", f"""WITH {BANK_CTE}
SELECT *, (SELECT count(*) FROM bank) AS total_count FROM bank ORDER BY created_at DESC, id DESC LIMIT 200
""")
def q_bank_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bk.bank_list(fx.question_bank(spark, sf_dir))


@register("bank_list_filtered", f"""WITH {BANK_CTE},
f AS (SELECT * FROM bank WHERE question_type = 'multiple_choice' AND difficulty = 3)
SELECT *, (SELECT count(*) FROM f) AS total_count FROM f ORDER BY created_at DESC, id DESC LIMIT 500
""")
def q_bank_list_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bk.bank_list(fx.question_bank(spark, sf_dir), "multiple_choice", 3, 500)
