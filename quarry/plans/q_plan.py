"""Registered multi-topic retrieval, schedule, context and grading queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import source_paths
from quarry.operators import quality as q
from quarry.operators import retrieval as rt
from quarry.operators import schedule as sc
from quarry.plans import fixtures as fx
from quarry.plans.q_retrieval import HYBRID_CTES
from quarry.plans.registry import register
from quarry.plans.sql_fragments import DOC_PATH_SQL, LINE_INDEX_SQL, bucket_counts_sql

WS = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}]"

TOPICS_SQL = f"""
    SELECT session_id, unnest(topics) AS topic, generate_subscripts(topics, 1) - 1 AS topic_pos,
           len(topics) AS n_topics, {fx.RESULTS_PER_SESSION} AS total_results, requested
    FROM (
        SELECT session_id, requested, list_filter(parts, lambda x, i: list_position(parts, x) = i) AS topics
        FROM (
            SELECT item_id AS session_id, CAST(item_id % 9 + 2 AS INTEGER) AS requested,
                   list_filter(list_transform(string_split(regexp_replace(text, '[.!?]', ',', 'g'), ','),
                                              lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')),
                               lambda x: x <> '') AS parts
            FROM benchmark))
"""

BUDGET_SQL = f"""
    SELECT *, CAST(floor(total_results / n_topics)
                   + CASE WHEN topic_pos < total_results % n_topics THEN 1 ELSE 0 END AS INTEGER) AS topic_limit
    FROM ({TOPICS_SQL})
"""

MERGED_SQL = f"""
WITH idx AS ({LINE_INDEX_SQL}),
tl AS (SELECT * FROM ({BUDGET_SQL}) WHERE topic_limit > 0),
cb AS ({bucket_counts_sql("SELECT * FROM idx", "source_path, chunk_index", "content")}),
tb AS ({bucket_counts_sql("SELECT * FROM tl", "session_id, topic_pos", "topic")}),
cn AS (SELECT source_path, chunk_index, sqrt(sum(c * c)) AS n FROM cb GROUP BY ALL),
tn AS (SELECT session_id, topic_pos, sqrt(sum(c * c)) AS n FROM tb GROUP BY ALL),
vsim AS (
    SELECT tb.session_id, tb.topic_pos, cb.source_path, cb.chunk_index,
           sum(tb.c * cb.c) / (any_value(tn.n) * any_value(cn.n)) AS sim
    FROM tb JOIN cb USING (b) JOIN tn USING (session_id, topic_pos) JOIN cn USING (source_path, chunk_index)
    GROUP BY ALL),
hits AS (
    SELECT v.*, tl.topic, row_number() OVER (PARTITION BY v.session_id, v.topic_pos
                                            ORDER BY sim DESC, source_path, chunk_index) AS rank, tl.topic_limit
    FROM vsim v JOIN tl USING (session_id, topic_pos)),
merged AS (
    SELECT h.session_id, h.source_path, h.chunk_index, i.content,
           arg_min(sim, struct_pack(p := topic_pos, r := rank)) AS similarity,
           list(topic ORDER BY topic_pos) AS matched_topics,
           min(struct_pack(p := topic_pos, r := rank)) AS f
    FROM hits h JOIN idx i USING (source_path, chunk_index) WHERE rank <= topic_limit GROUP BY ALL)
SELECT session_id, source_path, chunk_index, content, similarity, matched_topics,
       CAST(row_number() OVER (PARTITION BY session_id ORDER BY f.p, f.r) AS INTEGER) AS "order"
FROM merged
"""


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.session_retrieval(spark, sf_dir)


@register("topic_budget", f"SELECT session_id, topic_pos, topic, topic_limit FROM ({BUDGET_SQL})")
def q_topic_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rt.explode_topics(fx.topic_sessions(spark, sf_dir))
    return t.select("session_id", F.col("topic_pos").cast("long").alias("topic_pos"), "topic",
                    rt.topic_budget(t, "total_results", 5).alias("topic_limit"))


@register("multi_topic_retrieve", f"""
SELECT session_id, source_path, chunk_index, round(similarity, 6) AS similarity, matched_topics, "order"
FROM ({MERGED_SQL})
""")
def q_multi_topic_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select("session_id", "source_path", "chunk_index",
                                        F.round("similarity", 6).alias("similarity"), "matched_topics", "order")


@register("multi_topic_hybrid", f"""
WITH idx AS ({LINE_INDEX_SQL}),
tl AS (SELECT *, session_id || ':' || topic_pos AS query_id, topic AS query FROM ({BUDGET_SQL}) WHERE topic_limit > 0),
q AS (SELECT query_id, query FROM tl),
lim AS (SELECT query_id, greatest(4 * topic_limit, 20) AS cand, topic_limit AS k FROM tl),
{HYBRID_CTES},
merged AS (
    SELECT tl.session_id, f.source_path, f.chunk_index, i.content,
           arg_min(struct_pack(v := vector_similarity, l := lexical_score, h := hybrid_score),
                   struct_pack(p := topic_pos, r := hybrid_rank)) AS s,
           list(topic ORDER BY topic_pos) AS matched_topics,
           min(struct_pack(p := topic_pos, r := hybrid_rank)) AS f
    FROM final f JOIN tl USING (query_id) JOIN idx i USING (source_path, chunk_index)
    WHERE f.hybrid_rank <= tl.topic_limit GROUP BY ALL)
SELECT session_id, source_path, chunk_index, round(s.v, 6) AS vector_similarity, round(s.l, 6) AS lexical_score,
       round(s.h, 6) AS hybrid_score, matched_topics,
       CAST(row_number() OVER (PARTITION BY session_id ORDER BY f.p, f.r) AS INTEGER) AS "order"
FROM merged
""")
def q_multi_topic_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default mode: each topic's vector and lexical lists fused, then merged by chunk."""
    out = fx.session_retrieval(spark, sf_dir, mode="hybrid")
    return out.select("session_id", "source_path", "chunk_index",
                      *[F.round(c, 6).alias(c) for c in ("vector_similarity", "lexical_score", "hybrid_score")],
                      "matched_topics", "order")


@register("context_assembly", f"""
SELECT session_id, string_agg('Topics: ' || array_to_string(matched_topics, ', ') || chr(10) || 'Source: '
                              || source_path || chr(10) || content, chr(10) || chr(10) ORDER BY "order") AS context
FROM ({MERGED_SQL}) GROUP BY session_id
""")
def q_context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.context_assembly(merged(spark, sf_dir))


@register("unique_chunks", f"""
SELECT session_id, CAST("order" - 1 AS INTEGER) AS chunk_pos, source_path, chunk_index FROM ({MERGED_SQL})
""")
def q_unique_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.unique_chunks(merged(spark, sf_dir)).select("session_id", "chunk_pos", "source_path", "chunk_index")


ROUND_ROBIN_SQL = f"""
    SELECT m.session_id, s.slot, m.source_path, m.chunk_index
    FROM (SELECT *, "order" - 1 AS chunk_pos, count(*) OVER (PARTITION BY session_id) AS u FROM ({MERGED_SQL})) m
    JOIN (SELECT DISTINCT session_id, requested FROM ({TOPICS_SQL})) r USING (session_id),
         LATERAL (SELECT unnest(range(CASE WHEN m.u = 1 THEN least(r.requested, 2) ELSE r.requested END)) AS slot) s
    WHERE s.slot % m.u = m.chunk_pos
"""


def _round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = rt.unique_chunks(merged(spark, sf_dir))
    counts = fx.topic_sessions(spark, sf_dir).select("session_id", "requested")
    return sc.round_robin_schedule(chunks, counts)


@register("round_robin_schedule", f"SELECT session_id, CAST(slot AS INTEGER) AS slot, source_path, chunk_index "
                                  f"FROM ({ROUND_ROBIN_SQL})")
def q_round_robin_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_robin(spark, sf_dir).select("session_id", F.col("slot").cast("int"), "source_path", "chunk_index")


@register("random_schedule", f"""
WITH rr AS ({ROUND_ROBIN_SQL}),
tries AS (
    SELECT rr.*, t.shuffle_try,
           CAST(row_number() OVER (PARTITION BY session_id, t.shuffle_try
                ORDER BY ('0x' || substr(md5(concat_ws(':', '0', CAST(session_id AS VARCHAR),
                          CAST(t.shuffle_try AS VARCHAR), CAST(slot AS VARCHAR))), 1, 8))::BIGINT, slot) - 1
                AS INTEGER) AS position
    FROM rr, (SELECT unnest(range(10)) AS shuffle_try) t),
flagged AS (
    SELECT *, coalesce(lag(source_path) OVER w = source_path AND lag(chunk_index) OVER w = chunk_index, false) AS rep
    FROM tries WINDOW w AS (PARTITION BY session_id, shuffle_try ORDER BY position)),
chosen AS (
    SELECT n.session_id, CASE WHEN n.cnt < 2 THEN -1 ELSE coalesce(v.t, -1) END AS chosen
    FROM (SELECT session_id, count(*) AS cnt FROM rr GROUP BY ALL) n
    LEFT JOIN (SELECT session_id, min(shuffle_try) AS t FROM (
                 SELECT session_id, shuffle_try FROM flagged GROUP BY ALL HAVING NOT bool_or(rep))
               GROUP BY ALL) v USING (session_id))
SELECT f.session_id, f.position, f.source_path, f.chunk_index, f.shuffle_try
FROM flagged f JOIN chosen c ON c.session_id = f.session_id AND f.shuffle_try = c.chosen
UNION ALL
SELECT rr.session_id, CAST(rr.slot AS INTEGER), rr.source_path, rr.chunk_index, -1
FROM rr JOIN chosen c ON c.session_id = rr.session_id AND c.chosen = -1
""")
def q_random_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (sc.random_schedule(_round_robin(spark, sf_dir), seed=0)
            .select("session_id", "position", "source_path", "chunk_index", F.col("shuffle_try").cast("long")))


@register("schedule_check", f"""
SELECT r.session_id, r.requested, coalesce(s.scheduled, 0) AS scheduled,
       coalesce(s.scheduled, 0) = r.requested AS count_ok
FROM (SELECT DISTINCT session_id, requested FROM ({TOPICS_SQL})) r
LEFT JOIN (SELECT session_id, count(*) AS scheduled FROM ({ROUND_ROBIN_SQL}) GROUP BY ALL) s USING (session_id)
""")
def q_schedule_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = fx.topic_sessions(spark, sf_dir).select("session_id", "requested")
    return sc.strict_count_check(_round_robin(spark, sf_dir), counts).select(
        "session_id", "requested", "scheduled", "count_ok")


GRADE_BASE_SQL = f"""
    SELECT d.doc_id AS candidate_id, ['short_answer', 'single_choice', 'multiple_choice'][(d.doc_id % 3) + 1] AS qtype,
           d.source, d.lang, {DOC_PATH_SQL} AS path
    FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id
"""


@register("grade_choice", f"""
SELECT candidate_id, answer_error, CASE WHEN answer_error IS NULL THEN
         list_sort(list_distinct(list_transform(selected, lambda x: lower(trim(x)))))
         = list_sort(list_distinct(list_transform(expected, lambda x: lower(trim(x))))) END AS is_correct
FROM (
    SELECT *, CASE WHEN len(list_filter(selected, lambda x: trim(x) <> '')) = 0
                   THEN 'user_answer must be a non-empty string' END AS answer_error
    FROM (
        SELECT candidate_id, CASE WHEN qtype = 'single_choice' THEN [source] ELSE [source, lang] END AS expected,
               CASE candidate_id % 4 WHEN 0 THEN [' ' || upper(source) || ' ', upper(lang)]
                                     WHEN 1 THEN [lang, source] WHEN 2 THEN [source]
                                     ELSE CAST([] AS VARCHAR[]) END AS selected
        FROM ({GRADE_BASE_SQL}) WHERE qtype <> 'short_answer'))
""")
def q_grade_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.question_records(spark, sf_dir).where(F.col("question.question_type") != "short_answer")
    doc = F.col("candidate_id")
    src, lang = F.col("question.options")[0], F.col("question.options")[1]
    selected = (F.when(doc % 4 == 0, F.array(F.concat(F.lit(" "), F.upper(src), F.lit(" ")), F.upper(lang)))
                .when(doc % 4 == 1, F.array(lang, src)).when(doc % 4 == 2, F.array(src))
                .otherwise(F.array().cast("array<string>")))
    g = q.grade_choice(r.select("candidate_id", selected.alias("selected"),
                                F.col("question.expected_answer").alias("expected_answer")))
    return g.select("candidate_id", "answer_error", "is_correct")


@register("grade_short", f"""
SELECT candidate_id, CASE WHEN trim(answer) = '' THEN 'user_answer must be a non-empty string' END AS answer_error,
       CASE WHEN trim(answer) <> '' THEN lower(trim(answer)) = lower(lang) END AS is_correct
FROM (SELECT candidate_id, lang, CASE candidate_id % 3 WHEN 0 THEN '  ' || upper(lang) || ' '
                                                      WHEN 1 THEN source ELSE '' END AS answer
      FROM ({GRADE_BASE_SQL}) WHERE qtype = 'short_answer')
""")
def q_grade_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fx.question_records(spark, sf_dir).where(F.col("question.question_type") == "short_answer")
    doc = F.col("candidate_id")
    lang = F.col("question.expected_answer")[0]
    src = F.regexp_extract(F.col("question.explanation"), "^from (.*)$", 1)
    answer = (F.when(doc % 3 == 0, F.concat(F.lit("  "), F.upper(lang), F.lit(" ")))
              .when(doc % 3 == 1, src).otherwise(F.lit("")))
    g = q.grade_short(r.select("candidate_id", answer.alias("user_answer"),
                               F.col("question.expected_answer").alias("expected_answer")))
    return g.select("candidate_id", "answer_error", "is_correct")


@register("source_paths", f"""
SELECT candidate_id, [path] AS source_paths FROM ({GRADE_BASE_SQL})
""")
def q_source_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.question_records(spark, sf_dir).select("candidate_id",
                                                     source_paths("source_paths").alias("source_paths"))


# A prompt template of this library (placeholders are filled per row).
PROMPT_TEMPLATE = ("Write one question at difficulty {difficulty} of 5 about: {topics}.\n"
                   "Angle: {angle}.\nContext:\n{context}")


@register("prompt_rows", f"""
WITH rr AS ({ROUND_ROBIN_SQL}),
m AS ({MERGED_SQL}),
t AS (SELECT DISTINCT session_id, topic, topic_pos FROM ({TOPICS_SQL})),
lab AS (SELECT session_id, string_agg(topic, '; ' ORDER BY topic_pos) AS topics FROM t GROUP BY ALL)
SELECT rr.session_id, CAST(rr.slot AS INTEGER) AS slot,
       'Write one question at difficulty 3 of 5 about: ' || lab.topics || '.' || chr(10) || 'Angle: ' ||
       ['explain a mechanism or cause', 'identify an effect or consequence', 'compare two related concepts',
        'apply a concept to a concrete scenario', 'explain a trade-off or design decision',
        'trace a process or sequence'][
           (('0x' || substr(md5(concat_ws(':', '0', CAST(rr.session_id AS VARCHAR), CAST(rr.slot AS VARCHAR))),
                            1, 8))::BIGINT % 6) + 1] || '.' || chr(10) || 'Context:' || chr(10) ||
       'Topics: ' || array_to_string(m.matched_topics, ', ') || chr(10) || 'Source: ' || m.source_path || chr(10)
       || m.content AS prompt
FROM rr JOIN m USING (session_id, source_path, chunk_index) JOIN lab USING (session_id)
""")
def q_prompt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation prompt per scheduled slot: one chunk's context, seeded angle, topic label."""
    from quarry.functions.text import topic_label
    slots = _round_robin(spark, sf_dir).join(fx.topic_sessions(spark, sf_dir).select("session_id", "topics"), "session_id")
    prompt = rt.fill_template(
        PROMPT_TEMPLATE, difficulty=F.lit(3), topics=topic_label("topics"),
        angle=sc.choose_angle(F.col("session_id"), F.col("slot"), seed=0),
        context=rt.context_block(F.col("matched_topics"), F.col("source_path"), F.col("content")))
    return slots.select("session_id", F.col("slot").cast("int"), prompt.alias("prompt"))
