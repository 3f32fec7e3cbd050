"""Registered queries of rejects, cascades, constraints, history, prompts, prices, topics and cell search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import accounting, bank, blockmax, cells, constraints, deletes, hybrid, rejects
from quarry.operators import index as ix
from quarry.operators import quality as q
from quarry.operators import retrieval as rt
from quarry.operators import schedule as sc
from quarry.operators import sessions as ss
from quarry.operators import versions
from quarry.operators.embedding import DEFAULT_DIM, check_dimension, embed_hashing, sparse_vectors
from quarry.operators.vector_search import cosine_expr, recall_at_k, vector_topk
from quarry.plans import fixtures as fx
from quarry.plans.chunk_sql import chunk_sql
from quarry.plans.q_bank import BANK_CTE
from quarry.plans.q_index import KB_FILES_SQL, MARKDOWN_SQL, OLD_INDEX_SQL, SELECTED_SQL
from quarry.plans.q_quality import ATTEMPTS_SQL, CHECKED_SQL
from quarry.plans.q_retrieval import HYBRID_CTES, LEX_CTE, SCORES, rounded
from quarry.plans.registry import register
from quarry.plans.sql_fragments import (
    ANSWERS_SQL, DOC_PATH_SQL, LINE_INDEX_SQL, VECTOR_INDEX_SQL, bucket_counts_sql, lexical_sql, postings_sql, query_terms_sql,
)
from quarry.session import checkpoint_dir, write_table


def _root(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


# --- short queries: block-max lists and hybrid results ------------------------------------
WORDS_SQL = """
    WITH w AS (SELECT item_id, regexp_extract_all(text, '\\p{L}+') AS w FROM benchmark),
    p AS (SELECT item_id, w, unnest(range(0, least(len(w) - 4, 11) + 1)) AS i FROM w WHERE len(w) >= 4)
    SELECT item_id * 1000 + i * 4 + f.form AS query_id,
           CASE f.form WHEN 0 THEN w[i + 1] || ' ' || w[i + 2] WHEN 1 THEN '"' || w[i + 1] || ' ' || w[i + 2] || '"'
                       WHEN 2 THEN w[i + 1] || ' ' || w[i + 2] || ' -' || w[i + 4]
                       ELSE w[i + 1] || ' ' || w[i + 3] || ' or ' || w[i + 4] END AS query
    FROM p, (SELECT unnest([0, 1, 2, 3]) AS form) f
"""
WORDS_HEAD = f"WITH idx AS ({LINE_INDEX_SQL}), q AS ({WORDS_SQL}),"
# A query of which only negated words are left (the others are stop words) matches all chunks without them, score 0.
WORDS_LEX = lexical_sql(postings_sql("SELECT * FROM idx"), query_terms_sql("SELECT * FROM q")).replace("scored_ AS (", "covered_ AS (") + """,
absent_ AS (SELECT g.query_id, c.source_path, c.chunk_index
            FROM (SELECT query_id, group_id FROM terms_ GROUP BY ALL HAVING bool_and(negated)) g, idx c
            WHERE NOT EXISTS (SELECT 1 FROM item_hit_ h WHERE h.query_id = g.query_id AND h.group_id = g.group_id
                              AND h.source_path = c.source_path AND h.chunk_index = c.chunk_index)),
scored_ AS (SELECT query_id, source_path, chunk_index, max(lexical_score) AS lexical_score
            FROM (SELECT * FROM covered_ UNION ALL SELECT *, CAST(0 AS DOUBLE) FROM absent_) GROUP BY ALL)
"""


@register("lexical_blocks", f"""{WORDS_HEAD} {WORDS_LEX}
SELECT query_id, source_path, chunk_index, round(lexical_score, 6) AS lexical_score, lexical_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, source_path, chunk_index) AS lexical_rank
    FROM scored_) WHERE lexical_rank <= 20
""")
def q_lexical_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 20 chunks of every short query from the block index."""
    index = blockmax.build_block_index(fx.line_index(spark, sf_dir))
    top, _ = blockmax.lexical_topk_blocks(index, fx.word_queries(spark, sf_dir), 20)
    return top.withColumn("lexical_score", F.round("lexical_score", 6))


@register("hybrid_words", f"""{WORDS_HEAD} lim AS (SELECT query_id, 20 AS cand, 5 AS k FROM q), {HYBRID_CTES.replace(LEX_CTE, WORDS_LEX)}
SELECT f.query_id, f.source_path, f.chunk_index, round(f.vector_similarity, 6) AS vector_similarity,
       round(f.lexical_score, 6) AS lexical_score, f.vector_rank, f.lexical_rank,
       round(f.hybrid_score, 6) AS hybrid_score, f.hybrid_rank
FROM final f JOIN lim USING (query_id) WHERE f.hybrid_rank <= lim.k
""")
def q_hybrid_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search of every short query, its lexical list from the block index."""
    index = write_table(fx.hybrid_index(spark, sf_dir), "index")
    blocks = blockmax.build_block_index(index)
    queries = embed_hashing(fx.word_queries(spark, sf_dir), "query")
    out = hybrid.hybrid_search(index, queries, k=5, block_index=blocks)
    return rounded(out.select("query_id", "source_path", "chunk_index", *SCORES[:2], "vector_rank", "lexical_rank", "hybrid_score", "hybrid_rank"))


# --- approximate search over cells ---------------------------------------------------------
CELL_RECALL, CELL_K = 0.92, 5


def _cell_search(spark: SparkSession, sf_dir: str):
    lines = fx.hybrid_index(spark, sf_dir).select("source_path", "chunk_index", "embedding", F.xxhash64("embedding").alias("hash"))
    index = write_table(sparse_vectors(lines), "index")
    queries = write_table(fx.hybrid_queries(spark, sf_dir).select("query_id", "embedding"), "queries")
    held = cells.build_cells(index, ("source_path", "chunk_index"), hash_col="hash")
    probes = cells.calibrated_probes(held, queries, CELL_RECALL, CELL_K)
    return index, queries, held, probes


@register("cell_search")
def q_cell_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest lines of every passage by the calibrated probe list."""
    _, queries, held, probes = _cell_search(spark, sf_dir)
    return cells.search_cells(held, queries, CELL_K, probes).withColumn("similarity", F.round("similarity", 6))


@register("cell_recall", f"""{WORDS_HEAD.split(', q AS')[0]}, q AS (SELECT item_id AS query_id, text AS query FROM benchmark),
cb AS ({bucket_counts_sql("SELECT * FROM idx", "source_path, chunk_index", "content")}),
qb AS ({bucket_counts_sql("SELECT * FROM q", "query_id", "query")}),
hit AS (SELECT DISTINCT qb.query_id, cb.source_path, cb.chunk_index FROM qb JOIN cb USING (b)),
n AS (SELECT query_id, least(count(*), 5) AS k FROM hit GROUP BY ALL)
SELECT CAST(sum(k) AS BIGINT) AS exact_rows, true AS recall_reached, true AS fewer_scored FROM n
""")
def q_cell_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the exact search, whether the cells found at least 0.9 of them, and whether they scored fewer rows
    than it; ``cell_report`` has the figures."""
    index, queries, held, probes = _cell_search(spark, sf_dir)
    report = cell_report(index, queries, held, probes)
    return report.select("exact_rows", (F.col("recall") >= 0.9).alias("recall_reached"), (F.col("scored") < F.col("pairs")).alias("fewer_scored"))


def cell_report(index: DataFrame, queries: DataFrame, held: cells.CellIndex, probes: int) -> DataFrame:
    """exact_rows, found, recall, and pairs scored of all pairs."""
    exact = vector_topk(index, queries, CELL_K, payload_cols=())
    recall = recall_at_k(cells.search_cells(held, queries, CELL_K, probes), exact, "query_id", list(held.keys))
    scored = cells.search_cells(held, queries, CELL_K, probes, counted=True).agg(F.sum("scored").alias("scored"), (F.count(F.lit(1)) * int(held.rows.sum())).alias("pairs"))
    return recall.crossJoin(scored)  # one row each


# --- accepted and rejected rows --------------------------------------------------------------
@register("search_rejects", """
SELECT query_id, CASE WHEN item_blank THEN 'query must be a non-empty string' ELSE 'num_results must be a positive integer' END AS reject_reason
FROM (SELECT item_id AS query_id, item_id % 11 = 0 AS item_blank, item_id % 7 - 1 <= 0 AS bad_k FROM benchmark) WHERE item_blank OR bad_k
""")
def q_search_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = rejects.split_rejects(fx.search_requests(spark, sf_dir), rejects.search_rules())
    return split.rejected.select("query_id", "reject_reason")


@register("record_rejects", """
SELECT accepted, reject_reason, count(*) AS records FROM (
    SELECT CASE WHEN doc_id % 13 = 0 OR text IS NULL OR trim(text) = '' THEN 'question records must contain non-empty question text'
                WHEN doc_id % 7 NOT BETWEEN 1 AND 5 THEN 'question difficulty must be between 1 and 5' END AS reject_reason,
           reject_reason IS NULL AS accepted FROM documents) GROUP BY ALL
""")
def q_record_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a batch by the rule they break; the good ones are stored whatever the others are."""
    records = bank.normalize_records(fx.unchecked_records(spark, sf_dir)).select("candidate_id", "question_text", "store_difficulty")
    split = rejects.split_rejects(records, bank.bad_record())
    bad = split.rejected.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("records")).withColumn("accepted", F.lit(False))
    good = split.accepted.agg(F.count(F.lit(1)).alias("records")).select(F.lit(None).cast("string").alias("reject_reason"), "records", F.lit(True).alias("accepted"))
    return bad.unionByName(good).where("records > 0").select("accepted", "reject_reason", "records")


@register("output_rejects", f"""
SELECT slot_id, attempt_number, coalesce(parse_error, rule_error) AS reject_reason FROM ({CHECKED_SQL})
WHERE coalesce(parse_error, rule_error) IS NOT NULL
""")
def q_output_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated outputs that are no question, and why, from the same pass that keeps the others."""
    checked = q.question_rules(q.parse_outputs(fx.generation_attempts(spark, sf_dir))).select("slot_id", "attempt_number", "output_text", "parse_error", "rule_error")
    reason = F.coalesce("parse_error", "rule_error")
    split = rejects.split_rejects(checked, q.output_errors(reason))
    return split.rejected.select("slot_id", "attempt_number", "reject_reason")


# --- cascades and constraints -----------------------------------------------------------------
SESSION = deletes.Table("sessions", "id")
ANSWER = deletes.Table("answers", "answer_id", (("session_id", "sessions"),))
GONE_SQL = "o_orderkey % 5 = 0"


def _stored(spark: SparkSession, sf_dir: str) -> str:
    root = _root(spark, "store")
    deletes.store(fx.session_starts(spark, sf_dir).select("id", "started_at"), root, SESSION)
    answers = fx.answers(spark, sf_dir).select(F.concat_ws("-", "session_id", "question_number").alias("answer_id"), "session_id", "question_number", "is_correct")
    deletes.store(answers, root, ANSWER)
    return root


def _gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.session_starts(spark, sf_dir).where(F.col("id") % 5 == 0).select("id")


@register("cascade_delete", f"""
SELECT 'sessions' AS "table", count(*) AS live_rows, 0 AS orphans FROM orders WHERE NOT {GONE_SQL}
UNION ALL
SELECT 'answers', count(*), 0 FROM ({ANSWERS_SQL}) a WHERE session_id % 5 <> 0
""")
def q_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth session is deleted with its answers; what is left of both tables."""
    root, tables = _stored(spark, sf_dir), [SESSION, ANSWER]
    deletes.cascade_delete(spark, root, tables, "sessions", _gone(spark, sf_dir))
    lost = deletes.orphans(spark, root, tables).select("table", F.col("rows").cast("int").alias("orphans"))
    out = None
    for t in tables:
        one = deletes.live(spark, root, t).agg(F.count(F.lit(1)).alias("live_rows")).select(F.lit(t.name).alias("table"), "live_rows")
        out = one if out is None else out.unionByName(one)
    return out.join(lost, "table", "left").select("table", "live_rows", F.coalesce("orphans", F.lit(0)).alias("orphans"))


@register("orphans_left", f"""
SELECT 'answers' AS "table", 'session_id' AS "column", count(*) AS rows FROM ({ANSWERS_SQL}) a WHERE session_id % 5 = 0
""")
def q_orphans_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions deleted without a cascade: answers that refer to none."""
    root = _stored(spark, sf_dir)
    deletes.cascade_delete(spark, root, [SESSION], "sessions", _gone(spark, sf_dir))
    return deletes.orphans(spark, root, [SESSION, ANSWER])


JUDGED_RULES_SQL = " UNION ALL ".join(
    [f"SELECT 'judgments_{c}_range' AS rule, count(*) FILTER (WHERE NOT {x} BETWEEN 1 AND 5) AS violations FROM j"
     for c, x in (("groundedness_score", "g"), ("answer_correctness_score", "c"), ("clarity_score", "cl"), ("difficulty_score", "df"))])


@register("constraint_rules", f"""
WITH {BANK_CTE}, i AS ({VECTOR_INDEX_SQL}), j AS ({ATTEMPTS_SQL})
SELECT 'bank_question_type_not_null' AS rule, count(*) FILTER (WHERE question_type IS NULL) AS violations FROM bank
UNION ALL SELECT 'bank_question_text_not_null', count(*) FILTER (WHERE question_text IS NULL) FROM bank
UNION ALL SELECT 'bank_difficulty_range', count(*) FILTER (WHERE NOT difficulty BETWEEN 1 AND 5) FROM bank
UNION ALL SELECT 'bank_embedding_not_null', count(*) FILTER (WHERE question_text IS NULL) FROM rec WHERE in_bank
UNION ALL SELECT 'bank_unique_id', count(*) - count(DISTINCT id) FROM bank
UNION ALL SELECT 'documents_content_not_null', count(*) FILTER (WHERE content IS NULL) FROM i
UNION ALL SELECT 'documents_embedding_not_null', count(*) FILTER (WHERE embedding IS NULL) FROM i
UNION ALL SELECT 'documents_chunk_index_not_null', 0
UNION ALL SELECT 'documents_unique_source_path_chunk_index', count(*) - count(DISTINCT source_path) FROM i
UNION ALL SELECT 'judgments_question_text_not_null', count(*) FILTER (WHERE question_text IS NULL) FROM j
UNION ALL SELECT 'judgments_assigned_difficulty_range', count(*) FILTER (WHERE NOT assigned_difficulty BETWEEN 1 AND 5) FROM j
UNION ALL SELECT 'judgments_attempt_number_positive', count(*) FILTER (WHERE attempt_number <= 0) FROM j
UNION ALL {JUDGED_RULES_SQL}
""")
def q_constraint_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the bank, the chunk index and the judge's raw scores, each with the rows that break it."""
    stored = fx.question_bank(spark, sf_dir)
    out = constraints.violations(stored, "bank", constraints.bank_rules(), [("id",)])
    out = out.unionByName(constraints.violations(fx.vector_index(spark, sf_dir), "documents", constraints.document_rules(), [("source_path", "chunk_index")]))
    raw = fx.generation_attempts(spark, sf_dir).withColumns(
        {f: F.get_json_object("judge_text", f"$.{f}").try_cast("int") for f in q.SCORE_FIELDS})
    return out.unionByName(constraints.violations(raw, "judgments", constraints.judgment_rules()))


# --- history, grades and prompts ----------------------------------------------------------------
TURNS_SQL = """
    SELECT a.conv_id AS session_id, a.turn AS question_number, a.text AS question, b.text AS answer,
           (a.conv_id + a.turn) % 9 AS k,
           CASE WHEN (a.conv_id + a.turn) % 9 = 0 THEN NULL ELSE ((a.conv_id + a.turn) % 9) % 2 = 0 END AS is_correct
    FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
    WHERE a.role = 'user' AND b.role = 'assistant'
"""
ITEMS_SQL = f"""
    SELECT *, CAST(coalesce(sum(length(question) + length(answer) + 64) OVER (
               PARTITION BY session_id ORDER BY question_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
    FROM ({TURNS_SQL}) WHERE is_correct IS NOT NULL
"""
FRAME_SQL = f'OVER (PARTITION BY session_id ORDER BY "offset" RANGE BETWEEN {fx.HISTORY_BUDGET} PRECEDING AND 1 PRECEDING)'


@register("grade_records", f"""
SELECT session_id, question_number, is_correct,
       CASE WHEN is_correct IS NULL THEN 'returned an invalid correctness value' END AS grade_error FROM ({TURNS_SQL})
""")
def q_grade_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = q.grade_records(fx.graded_turns(spark, sf_dir))
    return graded.select("session_id", "question_number", F.when(F.col("grade_error").isNull(), F.col("parsed.is_correct")).alias("is_correct"), "grade_error")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = q.grade_records(fx.graded_turns(spark, sf_dir)).where("grade_error IS NULL")
    return ss.history_items(graded.select("session_id", "question_number", "question", "answer", F.col("parsed.is_correct").alias("is_correct")))


@register("running_history", """
SELECT conv_id, turn, coalesce(list(text) FILTER (WHERE role = 'user') OVER earlier, []) AS history,
       coalesce(list(reply) FILTER (WHERE role = 'user') OVER earlier, []) AS answers,
       coalesce(list(CASE WHEN reply IS NULL OR (conv_id + turn) % 9 = 0 THEN NULL ELSE ((conv_id + turn) % 9) % 2 = 0 END)
                FILTER (WHERE role = 'user') OVER earlier, []) AS correct
FROM (SELECT *, min(CASE WHEN role = 'assistant' THEN text END) OVER (
                    PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS reply FROM conversations)
WINDOW earlier AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def q_running_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with all questions asked before it, their answers and whether these were correct (null: not graded)."""
    graded = q.grade_records(fx.all_turns(spark, sf_dir))
    correct = F.when(F.col("grade_error").isNull(), F.col("parsed.is_correct"))
    out = ss.whole_history(graded.select("conv_id", "turn", "asked", "question", "answer", correct.alias("is_correct")), "conv_id", "turn")
    return out.select("conv_id", "turn", F.col("history.question").alias("history"), F.col("history.answer").alias("answers"),
                      F.col("history.correct").alias("correct"))


@register("history_prompt", f"""
SELECT session_id, question_number, coalesce(list(question) {FRAME_SQL}, []) AS questions,
       coalesce(list(answer) {FRAME_SQL}, []) AS answers, coalesce(list(is_correct) {FRAME_SQL}, []) AS correct FROM ({ITEMS_SQL})
""")
def q_history_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history that each question's prompt holds: question, answer and correctness, the latest that fit."""
    out = ss.running_history(_items(spark, sf_dir), fx.HISTORY_BUDGET, texts=True)
    return out.select("session_id", "question_number", F.col("history.question").alias("questions"), F.col("history.answer").alias("answers"),
                      F.col("history.correct").alias("correct"))


@register("grade_short_similar", f"""
WITH t AS ({TURNS_SQL}),
qb AS ({bucket_counts_sql("SELECT session_id, question_number, question FROM t", "session_id, question_number", "question")}),
ab AS ({bucket_counts_sql("SELECT session_id, question_number, answer FROM t", "session_id, question_number", "answer")}),
qn AS (SELECT session_id, question_number, sqrt(sum(c * c)) AS n FROM qb GROUP BY ALL),
an AS (SELECT session_id, question_number, sqrt(sum(c * c)) AS n FROM ab GROUP BY ALL),
s AS (SELECT session_id, question_number, sum(qb.c * ab.c) AS dot FROM qb JOIN ab USING (session_id, question_number, b) GROUP BY ALL)
SELECT t.session_id, t.question_number, round(coalesce(s.dot, 0) / (qn.n * an.n), 6) AS similarity,
       coalesce(coalesce(s.dot, 0) / (qn.n * an.n) >= 0.5, false) AS is_correct
FROM t LEFT JOIN s USING (session_id, question_number) LEFT JOIN qn USING (session_id, question_number) LEFT JOIN an USING (session_id, question_number)
""")
def q_grade_short_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies graded as short answers to the question's own words, by similarity where they are not equal."""
    t = embed_hashing(embed_hashing(fx.graded_turns(spark, sf_dir), "question", "qv"), "answer", "av").withColumn("similarity", cosine_expr("qv", "av"))
    g = q.grade_short(t.withColumn("expected_answer", F.array("question")), "answer", similarity_col="similarity", threshold=0.5)
    return g.select("session_id", "question_number", F.round("similarity", 6).alias("similarity"), "is_correct")


JUDGE_TEMPLATE = "Rate this question for difficulty {difficulty} of 5.\nQuestion: {question}\nContext:\n{context}"
GRADE_TEMPLATE = "Grade this answer.\nQuestion: {question}\nAnswer: {answer}"


@register("judge_prompts", f"""
SELECT slot_id, attempt_number, 'Rate this question for difficulty ' || assigned_difficulty || ' of 5.' || chr(10) || 'Question: '
       || CAST(to_json(struct_pack(question_type := qtype, question := question_text, options := opts, expected_answer := expected,
                                   explanation := 'from ' || session_id)) AS VARCHAR)
       || chr(10) || 'Context:' || chr(10) || 'Topics: ' || session_id || chr(10) || 'Source: ' || path || chr(10) || question_text AS prompt
FROM (SELECT a.slot_id, a.attempt_number, a.assigned_difficulty, a.qtype, a.question_text, a.opts, a.expected, a.session_id,
             a.parse_error, a.rule_error, {DOC_PATH_SQL.replace("CAST(doc_id", "CAST(d.doc_id").replace("source ||", "d.source ||").replace("lang ||", "d.lang ||")} AS path
      FROM ({CHECKED_SQL}) a JOIN documents d ON d.doc_id = a.slot_id) WHERE coalesce(parse_error, rule_error) IS NULL
""")
def q_judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judging prompt for each generated question that passes the rules: its JSON, difficulty and context."""
    checked = q.question_rules(q.parse_outputs(write_table(fx.generation_attempts(spark, sf_dir), "attempts")))
    checked = write_table(checked.drop("_json", "parsed"), "checked").where("parse_error IS NULL AND rule_error IS NULL")
    paths = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("slot_id"), fx.doc_path().alias("path"))
    context = rt.context_block(F.array("session_id"), F.col("path"), F.col("question_text"))
    prompt = rt.fill_template(JUDGE_TEMPLATE, difficulty=F.col("assigned_difficulty"), question=F.col("output_text"), context=context)
    return checked.join(paths, "slot_id").select("slot_id", "attempt_number", prompt.alias("prompt"))


@register("grade_prompts", f"""
SELECT session_id, question_number, 'Grade this answer.' || chr(10) || 'Question: ' || question || chr(10) || 'Answer: ' || answer AS prompt FROM ({TURNS_SQL})
""")
def q_grade_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = rt.fill_template(GRADE_TEMPLATE, question=F.col("question"), answer=F.col("answer"))
    return fx.graded_turns(spark, sf_dir).select("session_id", "question_number", prompt.alias("prompt"))


# --- prices, topics, display, session starts ---------------------------------------------------
@register("pricing_rules", """
SELECT s_name AS model, CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_acctbal < 0 THEN 'field input must be a finite, non-negative number' ELSE 'missing: cached_input' END
                             WHEN floor(s_acctbal) < 0 THEN 'field input must be a finite, non-negative number' END AS reject_reason,
       reject_reason IS NULL AS valid, CAST(CASE WHEN reject_reason IS NULL THEN floor(s_acctbal) END AS DOUBLE) AS input_rate
FROM supplier
""")
def q_pricing_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = accounting.pricing_rules(fx.price_entries(spark, sf_dir))
    return ruled.select("model", "reject_reason", "valid", F.when(F.col("valid"), F.col("input_rate")).alias("input_rate"))


@register("choose_topic", """
WITH t AS (SELECT source AS topic, row_number() OVER (ORDER BY source) - 1 AS topic_no FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
n AS (SELECT count(*) AS n FROM t)
SELECT b.item_id AS session_id, t.topic FROM benchmark b, n
JOIN t ON t.topic_no = ('0x' || substr(md5('0:' || CAST(b.item_id AS VARCHAR)), 1, 8))::BIGINT % n.n
""")
def q_choose_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded topic for each session, of the distinct sources."""
    names = fx.table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.col("source").alias("topic")).distinct()
    from pyspark.sql import Window
    topics = names.withColumn("topic_no", (F.row_number().over(Window.orderBy("topic")) - 1).cast("long"))  # one row a topic
    return sc.choose_topic(fx.topic_sessions(spark, sf_dir).select("session_id"), topics, seed=0).select("session_id", "topic")


@register("bank_display", f"""WITH {BANK_CTE}
SELECT id AS "ID", question_text AS "Question",
       CASE question_type WHEN 'short_answer' THEN 'Short Answer' WHEN 'single_choice' THEN 'Single Choice' ELSE 'Multiple Choice' END AS "Type",
       difficulty AS "Difficulty", array_to_string(source_paths, ', ') AS "Sources", created_at AS "Created"
FROM bank
""")
def q_bank_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank.display_rows(fx.question_bank(spark, sf_dir))


@register("session_starts", """
SELECT o_orderkey AS id, 'anon-' || o_custkey AS anonymous_session_id, o_orderdate AS started_at, CAST(NULL AS TIMESTAMP) AS completed_at,
       [o_orderstatus, o_orderpriority] AS topics, 7 AS requested_questions, CAST(0 AS BIGINT) AS answered_questions,
       CAST(0 AS BIGINT) AS correct_answers, false AS completed, false AS ended_early FROM orders
""")
def q_session_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.start_rows(fx.session_starts(spark, sf_dir))


# --- the whole ingest ------------------------------------------------------------------------------
INGESTED_SQL = chunk_sql(f"SELECT m.source_path, m.content FROM ({MARKDOWN_SQL}) m WHERE m.source_path IN (SELECT source_path FROM ({SELECTED_SQL}))")


@register("index_refresh", f"""
WITH c AS (SELECT * FROM ({INGESTED_SQL})),
cb AS ({bucket_counts_sql("SELECT * FROM c", "source_path, chunk_index", "content")}),
m AS (SELECT source_path, chunk_index, map(list(b), list(c)) AS m FROM cb GROUP BY ALL)
SELECT source_path, chunk_index, content, list_transform(range({DEFAULT_DIM}), lambda j: CAST(coalesce(m.m[j], 0) AS FLOAT)) AS embedding,
       f.modified_at AS source_last_updated_date, TIMESTAMP '{fx.REFRESH_NOW}' AS last_processed_date
FROM c LEFT JOIN m USING (source_path, chunk_index) JOIN ({KB_FILES_SQL}) f USING (source_path)
UNION ALL
SELECT o.source_path, o.chunk_index, o.content, CAST(NULL AS FLOAT[]), TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-01 00:00:00'
FROM ({OLD_INDEX_SQL}) o WHERE o.source_path NOT IN (SELECT source_path FROM ({SELECTED_SQL}))
""")
def q_index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Select what is recent or missing, chunk, embed, check, stamp, and replace by source in the stored index."""
    root = _root(spark, "index")
    old = fx.existing_index(spark, sf_dir)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    versions.create_index(root, old.select("*", F.lit(None).cast("array<float>").alias("embedding"), start.alias("source_last_updated_date"), start.alias("last_processed_date")))
    selected = write_table(ix.refresh_select(fx.kb_files(spark, sf_dir), versions.read_index(spark, root), fx.REFRESH_NOW, fx.REFRESH_DAYS), "selected")
    versions.refresh_index(root, selected, lambda files: check_dimension(ix.build_chunks(files, F.lit(fx.REFRESH_NOW).cast("timestamp_ntz")), "embedding", DEFAULT_DIM))
    return versions.read_index(spark, root)
