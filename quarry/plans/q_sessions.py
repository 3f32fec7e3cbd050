"""Registered session / answer / performance-dashboard queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import sessions as ss
from quarry.plans import fixtures as fx
from quarry.plans.registry import register
from quarry.plans.sql_fragments import ANSWER_EVENTS_SQL, ANSWERS_SQL, FINISH_SQL, SESSIONS_SQL

S_RANGE = "BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '2002-01-01 00:00:00'"
ANSWER_COLS = ("session_id, question_number, question_type, assigned_difficulty, next_difficulty, "
               "is_correct, answered_at")


@register("answers_first_wins", f"SELECT {ANSWER_COLS} FROM ({ANSWERS_SQL})")
def q_answers_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.answers(spark, sf_dir).select(*[c.strip() for c in ANSWER_COLS.split(",")])


@register("session_counters", f"""
SELECT session_id, count(*) AS answered_questions, count(*) FILTER (WHERE is_correct) AS correct_answers
FROM ({ANSWERS_SQL}) GROUP BY session_id
""")
def q_session_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.session_counters(fx.answers(spark, sf_dir))


@register("session_finish", f"""
SELECT session_id, f.finished_at AS completed_at, f.completed AS completed, f.ended_early AS ended_early
FROM ({FINISH_SQL})
""")
def q_session_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.session_finish(fx.finish_events(spark, sf_dir))


@register("sessions_build", f"SELECT * FROM ({SESSIONS_SQL})")
def q_sessions_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.sessions(spark, sf_dir)


@register("orphan_answers", f"""
SELECT {ANSWER_COLS} FROM ({ANSWERS_SQL}) a
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = a.session_id)
""")
def q_orphan_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (ss.orphan_answers(fx.answers(spark, sf_dir), fx.session_starts(spark, sf_dir))
            .select(*[c.strip() for c in ANSWER_COLS.split(",")]))


@register("tests_started", f"SELECT count(*) AS value FROM ({SESSIONS_SQL}) WHERE started_at {S_RANGE}")
def q_tests_started(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.tests_started(fx.sessions(spark, sf_dir), *fx.SESSION_RANGE)


@register("overall_accuracy", f"""
SELECT coalesce(100.0 * CAST(sum(correct_answers) AS DOUBLE)
                / CAST(nullif(sum(answered_questions), 0) AS DOUBLE), 0.0) AS value
FROM ({SESSIONS_SQL}) WHERE started_at {S_RANGE}
""")
def q_overall_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.overall_accuracy(fx.sessions(spark, sf_dir), *fx.SESSION_RANGE)


@register("accuracy_over_time", f"""
SELECT started_at AS time, id,
       100.0 * CAST(correct_answers AS DOUBLE) / CAST(nullif(answered_questions, 0) AS DOUBLE) AS accuracy_percent
FROM ({SESSIONS_SQL}) WHERE started_at {S_RANGE} AND answered_questions > 0 ORDER BY started_at, id
""")
def q_accuracy_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.accuracy_over_time(fx.sessions(spark, sf_dir), *fx.SESSION_RANGE)


@register("accuracy_by_difficulty", f"""
SELECT CAST(assigned_difficulty AS VARCHAR) AS difficulty, count(*) AS answered,
       100.0 * avg(CASE WHEN is_correct THEN 1 ELSE 0 END) AS accuracy_percent
FROM ({ANSWERS_SQL}) a JOIN orders s ON s.o_orderkey = a.session_id
WHERE a.answered_at {S_RANGE}
GROUP BY assigned_difficulty ORDER BY assigned_difficulty
""")
def q_accuracy_by_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.accuracy_by_difficulty(fx.answers(spark, sf_dir), fx.session_starts(spark, sf_dir),
                                     *fx.SESSION_RANGE)


@register("recent_sessions", f"""
SELECT id, anonymous_session_id, started_at, completed_at, topics, requested_questions, answered_questions,
       correct_answers,
       CAST((2000 * correct_answers + nullif(answered_questions, 0)) // (2 * nullif(answered_questions, 0))
            AS DOUBLE) / 10.0 AS accuracy_percent,
       completed, ended_early
FROM ({SESSIONS_SQL}) WHERE started_at {S_RANGE}
ORDER BY started_at DESC, id DESC LIMIT 100
""")
def q_recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.recent_sessions(fx.sessions(spark, sf_dir), *fx.SESSION_RANGE)


@register("test_summary", f"""
SELECT id AS session_id, correct_answers AS correct, answered_questions AS answered,
       requested_questions AS requested, ended_early
FROM ({SESSIONS_SQL})
""")
def q_test_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.test_summary(fx.sessions(spark, sf_dir))


@register("constraint_report", f"""
WITH ev AS (SELECT * FROM (__ANSWER_EVENTS__)),
s AS ({SESSIONS_SQL})
SELECT 'answers_question_number_positive' AS rule, count(*) FILTER (WHERE NOT question_number > 0) AS violations FROM ev
UNION ALL SELECT 'answers_assigned_difficulty_range', count(*) FILTER (WHERE NOT assigned_difficulty BETWEEN 1 AND 5) FROM ev
UNION ALL SELECT 'answers_next_difficulty_range', count(*) FILTER (WHERE NOT next_difficulty BETWEEN 1 AND 5) FROM ev
UNION ALL SELECT 'answers_is_correct_not_null', count(*) FILTER (WHERE is_correct IS NULL) FROM ev
UNION ALL SELECT 'answers_unique_session_question', coalesce(sum(n - 1), 0)
          FROM (SELECT count(*) AS n FROM ev GROUP BY session_id, question_number)
UNION ALL SELECT 'sessions_requested_positive', count(*) FILTER (WHERE NOT requested_questions > 0) FROM s
UNION ALL SELECT 'sessions_answered_non_negative', count(*) FILTER (WHERE NOT answered_questions >= 0) FROM s
UNION ALL SELECT 'sessions_correct_non_negative', count(*) FILTER (WHERE NOT correct_answers >= 0) FROM s
UNION ALL SELECT 'answers_session_fk', count(*) FROM ev
          WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.id = ev.session_id)
""".replace("__ANSWER_EVENTS__", ANSWER_EVENTS_SQL))
def q_constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.constraint_report(fx.answer_events(spark, sf_dir), fx.sessions(spark, sf_dir))


@register("difficulty_path", f"""
WITH RECURSIVE a AS (
    SELECT session_id, question_number, is_correct,
           row_number() OVER (PARTITION BY session_id ORDER BY question_number) AS step
    FROM ({ANSWERS_SQL})
), walk AS (
    SELECT session_id, question_number, is_correct, step, 3 AS assigned_difficulty,
           greatest(1, least(5, 3 + CASE WHEN is_correct THEN 1 ELSE -1 END)) AS next_difficulty
    FROM a WHERE step = 1
    UNION ALL
    SELECT a.session_id, a.question_number, a.is_correct, a.step, w.next_difficulty,
           greatest(1, least(5, w.next_difficulty + CASE WHEN a.is_correct THEN 1 ELSE -1 END))
    FROM walk w JOIN a ON a.session_id = w.session_id AND a.step = w.step + 1
)
SELECT session_id, question_number, is_correct, assigned_difficulty, next_difficulty FROM walk
""")
def q_difficulty_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.difficulty_path(fx.answers(spark, sf_dir))
