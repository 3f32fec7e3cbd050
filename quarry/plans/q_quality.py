"""Registered parsing / rules / judging / attempt-selection / grading queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import normalize_question_text, parse_topics
from quarry.operators import quality as q
from quarry.plans import fixtures as fx
from quarry.plans.registry import register
from quarry.plans.sql_fragments import LINE_INDEX_SQL
from quarry.session import write_table

WS = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}]"


def norm_sql(x: str) -> str:
    return (f"replace(lower(regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '^ | $', '', 'g')), "
            f"'ß', 'ss')")


ATTEMPTS_SQL = """
    SELECT slot_id, session_id, attempt_number, question_text, assigned_difficulty, k, quality, toxic,
           CASE WHEN k = 0 THEN '' WHEN k = 1 THEN '{"question": ' WHEN k = 2 THEN '[1, 2]'
                ELSE to_json(struct_pack(question_type := qtype, question := question_text, options := opts,
                                         expected_answer := expected, explanation := 'from ' || source)) END
             AS output_text,
           qtype, opts, expected, g, c, cl, df,
           CASE WHEN (slot_id + attempt_number) % 17 = 0 THEN NULL ELSE cl END AS cl_valid
    FROM (
        SELECT *, CASE WHEN qtype = 'short_answer' THEN ['' || lang]
                       WHEN qtype = 'single_choice' THEN [source] ELSE [source, lang] END AS expected
        FROM (
            SELECT *, CASE WHEN k = 4 THEN [source]
                           WHEN qtype = 'short_answer' THEN CAST([] AS VARCHAR[])
                           ELSE [source, lang, source || '-' || lang] END AS opts
            FROM (
                SELECT d.doc_id AS slot_id, d.source AS session_id, a.attempt_number, d.text AS question_text,
                       d.source, d.lang, l.quality, l.toxic,
                       CAST(d.doc_id % 5 + 1 AS INTEGER) AS assigned_difficulty,
                       (d.doc_id + a.attempt_number) % 10 AS k,
                       CASE WHEN (d.doc_id + a.attempt_number) % 10 = 3 THEN 'essay'
                            WHEN (d.doc_id + a.attempt_number) % 10 = 4 THEN 'multiple_choice'
                            ELSE ['short_answer', 'single_choice', 'multiple_choice'][(d.doc_id % 3) + 1] END AS qtype,
                       CASE WHEN (d.doc_id + a.attempt_number) % 13 = 0 THEN 6
                            ELSE (d.doc_id + 2 * a.attempt_number) % 5 + 1 END AS g,
                       least(5, 2 + l.quality * 2 + a.attempt_number % 2) AS c,
                       5 - l.toxic * 3 AS cl,
                       (d.doc_id * 7 + a.attempt_number) % 5 + 1 AS df
                FROM documents d JOIN labels l ON d.doc_id = l.doc_id,
                     (SELECT unnest([1, 2, 3]) AS attempt_number) a
            )
        )
    )
"""

CHECKED_SQL = f"""
    SELECT *,
           CASE WHEN k = 0 THEN 'returned no structured test_question output'
                WHEN k = 1 THEN 'returned invalid test_question JSON'
                WHEN k = 2 THEN 'returned an invalid test_question object' END AS parse_error,
           CASE WHEN k IN (0, 1, 2) THEN NULL
                WHEN qtype NOT IN ('short_answer', 'single_choice', 'multiple_choice') THEN 'unsupported question type'
                WHEN trim(question_text) = '' THEN 'empty question'
                WHEN len(expected) = 0 THEN 'invalid expected answer'
                WHEN qtype = 'short_answer' AND len(opts) > 0 THEN 'short-answer questions must not have options'
                WHEN qtype <> 'short_answer' AND NOT len(opts) BETWEEN 2 AND 5
                     THEN 'choice questions must have between 2 and 5 options'
                WHEN qtype = 'single_choice' AND len(expected) <> 1
                     THEN 'single-choice questions must have one expected answer' END AS rule_error,
           CASE WHEN g NOT BETWEEN 1 AND 5 THEN 'returned an invalid groundedness_score'
                WHEN cl_valid IS NULL THEN 'returned an invalid clarity_score' END AS judge_error,
           EXISTS (SELECT 1 FROM documents h WHERE h.doc_id NOT IN (SELECT doc_id FROM labels)
                   AND h.source = session_id AND {norm_sql('h.text')} = {norm_sql('question_text')}) AS is_duplicate
    FROM ({ATTEMPTS_SQL})
"""

OUTCOMES_SQL = f"""
    SELECT *, coalesce(parse_error, rule_error,
                       CASE WHEN is_duplicate THEN 'generated a duplicate question' END, judge_error,
                       CASE WHEN NOT passed THEN
                         printf('Quality judge rejected attempt %d: overall score %.1f/5 (required 4.0); '
                                || 'groundedness=%d/5, answer_correctness=%d/5, clarity=%d/5, difficulty=%d/5. '
                                || 'Groundedness: g%d; Answer correctness: c%d; Clarity: l%d; Difficulty: d%d',
                                attempt_number, overall_score, g, c, cl, df, g, c, cl, df) END) AS attempt_error
    FROM (
        SELECT *, CASE WHEN judge_error IS NULL THEN (g + c + cl + df) / 4.0 END AS overall_score,
               coalesce(judge_error IS NULL AND (g + c + cl + df) / 4.0 >= 4.0, false) AS passed
        FROM ({CHECKED_SQL}))
"""


#: The loop over attempts stops at the first that passes.
RUN_SQL = f"""
    SELECT o.* FROM ({OUTCOMES_SQL}) o
    WHERE NOT EXISTS (SELECT 1 FROM ({OUTCOMES_SQL}) e WHERE e.slot_id = o.slot_id
                      AND e.attempt_number < o.attempt_number AND e.attempt_error IS NULL)
"""
#: Audit columns that hold a value only when the judge gave a valid answer.
AUDIT_VALUES = {
    "overall_score": "CAST(overall_score AS DOUBLE)",
    "groundedness_score": "g", "answer_correctness_score": "CAST(c AS INTEGER)",
    "clarity_score": "CAST(cl AS INTEGER)", "difficulty_score": "CAST(df AS INTEGER)",
    "groundedness_explanation": "'g' || g", "answer_correctness_explanation": "'c' || c",
    "clarity_explanation": "'l' || cl", "difficulty_explanation": "'d' || df",
}


@register("parse_outputs", f"SELECT slot_id, attempt_number, parse_error FROM ({CHECKED_SQL})")
def q_parse_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.parse_outputs(fx.generation_attempts(spark, sf_dir)).select("slot_id", "attempt_number", "parse_error")


@register("question_rules", f"SELECT slot_id, attempt_number, rule_error FROM ({CHECKED_SQL})")
def q_question_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (q.question_rules(q.parse_outputs(fx.generation_attempts(spark, sf_dir)))
            .select("slot_id", "attempt_number", "rule_error"))


@register("quality_gate", f"""
SELECT slot_id, attempt_number, CAST(overall_score AS DOUBLE) AS overall_score, passed,
       CASE WHEN judge_error IS NOT NULL THEN 'error' WHEN passed THEN 'passed' ELSE 'failed' END AS judge_status,
       judge_error
FROM ({OUTCOMES_SQL})
""")
def q_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (q.quality_gate(fx.generation_attempts(spark, sf_dir))
            .select("slot_id", "attempt_number", "overall_score", "passed", "judge_status", "judge_error"))


@register("history_dedup", f"""
SELECT slot_id, attempt_number FROM ({CHECKED_SQL}) WHERE NOT is_duplicate
""")
def q_history_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (q.history_dedup(fx.generation_attempts(spark, sf_dir), fx.question_history(spark, sf_dir))
            .select("slot_id", "attempt_number"))


@register("first_passing_attempt", f"""
SELECT slot_id, min(attempt_number) FILTER (WHERE attempt_error IS NULL) AS passing_attempt,
       count(*) AS attempts_made,
       min(attempt_number) FILTER (WHERE attempt_error IS NULL) IS NOT NULL AS passed,
       CASE WHEN min(attempt_number) FILTER (WHERE attempt_error IS NULL) IS NULL
            THEN 'Could not generate a quality-approved question: ' || arg_max(attempt_error, attempt_number) END
         AS error
FROM ({RUN_SQL}) GROUP BY slot_id
""")
def q_first_passing_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.first_passing_attempt(fx.judged_attempts(spark, sf_dir), ["slot_id"])


@register("judgment_audit", f"""
SELECT slot_id, attempt_number, judge_status, assigned_difficulty, question_text AS question, qtype AS question_type,
       opts AS options, expected AS expected_answer,
       {", ".join(f"CASE WHEN judge_status <> 'error' THEN {v} END AS {c}" for c, v in AUDIT_VALUES.items())}
FROM (SELECT *, CASE WHEN is_duplicate OR judge_error IS NOT NULL THEN 'error'
                     WHEN passed THEN 'passed' ELSE 'failed' END AS judge_status
      FROM ({RUN_SQL}) WHERE parse_error IS NULL AND rule_error IS NULL)
""")
def q_judgment_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (q.judgment_audit(fx.judged_attempts(spark, sf_dir), ["slot_id"])
            .select("slot_id", "attempt_number", "judge_status", "assigned_difficulty",
                    *[F.col(f"parsed.{c}").alias(c)
                      for c in ("question", "question_type", "options", "expected_answer")],
                    *AUDIT_VALUES))


@register("approved_only", f"""
SELECT o.slot_id, o.attempt_number, o.qtype AS question_type, o.assigned_difficulty
FROM ({OUTCOMES_SQL}) o
JOIN (SELECT slot_id, min(attempt_number) FILTER (WHERE attempt_error IS NULL) AS a
      FROM ({OUTCOMES_SQL}) GROUP BY slot_id) w ON w.slot_id = o.slot_id AND w.a = o.attempt_number
""")
def q_approved_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.operators.bank import approved_only
    # Outputs are parsed and judged once; what is joined afterwards has no texts.
    outcomes = write_table(fx.judged_attempts(spark, sf_dir).select(
        "slot_id", "attempt_number", F.col("parsed.question_type").alias("question_type"), "assigned_difficulty", "ok", "attempt_error"), "outcomes")
    first = q.first_passing_attempt(outcomes, ["slot_id"])
    chosen = (outcomes.join(first.select("slot_id", F.col("passing_attempt").alias("attempt_number"),
                                         F.col("passed").alias("slot_passed")), ["slot_id", "attempt_number"])
              .select("slot_id", "attempt_number", "question_type", "assigned_difficulty", F.col("slot_passed").alias("judge_passed")))
    return approved_only(chosen, "judge_passed").drop("judge_passed")


@register("norm_questions", f"""
SELECT source_path, chunk_index, {norm_sql('content')} AS norm_text FROM ({LINE_INDEX_SQL})
""")
def q_norm_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.line_index(spark, sf_dir).select("source_path", "chunk_index",
                                               normalize_question_text(F.col("content")).alias("norm_text"))


@register("parse_topics", f"""
SELECT source_path, chunk_index,
       list_filter(parts, lambda x, i: list_position(parts, x) = i) AS topics
FROM (
    SELECT source_path, chunk_index,
           list_filter(list_transform(string_split(content, ','),
                                      lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')),
                       lambda x: x <> '') AS parts
    FROM ({LINE_INDEX_SQL}))
""")
def q_parse_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.line_index(spark, sf_dir).select("source_path", "chunk_index",
                                               parse_topics(F.col("content")).alias("topics"))


CHOSEN_SQL = f"""
    SELECT o.session_id, o.slot_id, o.attempt_number, o.toxic,
           w.a IS NOT NULL AS judge_passed,
           o.slot_id = max(o.slot_id) OVER (PARTITION BY o.session_id) AS is_open
    FROM ({OUTCOMES_SQL}) o
    JOIN (SELECT slot_id, coalesce(min(attempt_number) FILTER (WHERE attempt_error IS NULL), max(attempt_number)) AS a0,
                 min(attempt_number) FILTER (WHERE attempt_error IS NULL) AS a
          FROM ({OUTCOMES_SQL}) GROUP BY slot_id) w ON w.slot_id = o.slot_id AND w.a0 = o.attempt_number
"""


@register("bank_candidates", f"""
SELECT session_id, slot_id, attempt_number FROM ({CHOSEN_SQL}) c
WHERE judge_passed AND (NOT is_open OR EXISTS (
    SELECT 1 FROM ({CHOSEN_SQL}) e WHERE e.session_id = c.session_id AND e.is_open AND e.toxic = 1))
""")
def q_bank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per session (source): the last slot is the open question; the session ended early when
    that slot's document is labelled toxic."""
    from pyspark.sql import Window
    from quarry.operators.bank import bank_candidates
    outcomes = fx.judged_attempts(spark, sf_dir)
    first = q.first_passing_attempt(outcomes, ["slot_id"])
    shown = F.coalesce(F.col("passing_attempt"), F.col("attempts_made"))
    chosen = (outcomes.join(first.select("slot_id", shown.alias("attempt_number"),
                                         F.col("passed").alias("judge_passed")), ["slot_id", "attempt_number"])
              .join(fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("slot_id"), "toxic"), "slot_id")
              .withColumn("is_open", F.col("slot_id") == F.max("slot_id").over(Window.partitionBy("session_id")))
              .select("session_id", "slot_id", "attempt_number", "judge_passed", "is_open", "toxic"))
    sessions = chosen.where("is_open").select("session_id", (F.col("toxic") == 1).alias("ended_early"))
    cols = ["session_id", "slot_id", "attempt_number", "judge_passed"]
    out = bank_candidates(chosen.where(~F.col("is_open")).select(*cols),
                          chosen.where("is_open").select(*cols), sessions)
    return out.select("session_id", "slot_id", "attempt_number")
