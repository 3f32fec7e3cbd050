"""Structured-output parsing, question rules, judge gate, attempt selection and grading
(OP-V1..V7, OP-G1..G3, OP-J5, OP-W5, OP-A13, OP-P2, OP-S9).

Generation and judging calls are outside Spark; their raw outputs arrive as
tables and every rule of the reference runs as columns over whole batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import normalize_question_text, strip_unicode

# Fixed values from the reference.
QUESTION_TYPES = ("short_answer", "single_choice", "multiple_choice")
SCORE_FIELDS = ("groundedness_score", "answer_correctness_score", "clarity_score", "difficulty_score")
EXPLANATION_FIELDS = ("groundedness_explanation", "answer_correctness_explanation",
                      "clarity_explanation", "difficulty_explanation")
SCORE_LABELS = ("Groundedness", "Answer correctness", "Clarity", "Difficulty")
DEFAULT_PASS_THRESHOLD = 4.0
DEFAULT_MAX_ATTEMPTS = 3

QUESTION_SCHEMA = T.StructType([
    T.StructField("question_type", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("options", T.ArrayType(T.StringType())),
    T.StructField("expected_answer", T.ArrayType(T.StringType())),
    T.StructField("explanation", T.StringType()),
])
GRADE_SCHEMA = T.StructType([
    T.StructField("is_correct", T.BooleanType()),
    T.StructField("correct_answer", T.ArrayType(T.StringType())),
    T.StructField("feedback", T.StringType()),
    T.StructField("explanation", T.StringType()),
])


def check_gate_config(threshold: float, max_attempts: int) -> None:
    if max_attempts <= 0:
        raise ValueError("max attempts must be positive")
    if not 1 <= threshold <= 5:
        raise ValueError("pass threshold must be between 1 and 5")


def parse_outputs(df: DataFrame, text_col: str = "output_text", schema: T.StructType = QUESTION_SCHEMA,
                  name: str = "test_question") -> DataFrame:
    """Non-blank text, valid JSON, a JSON object; adds ``parse_error`` and ``parsed``."""
    raw = F.col(text_col)
    # One parse per output: the VARIANT feeds the error, the typed struct and the type checks.
    return (df.withColumn("_json", F.try_parse_json(raw))
            .withColumn("parse_error", _parse_error(raw, name, F.col("_json")))
            .withColumn("parsed", F.when(F.col("parse_error").isNull(),
                                         F.try_variant_get(F.col("_json"), "$", schema.simpleString()))))


def _parse_error(raw: Column, name: str, parsed: Column | None = None) -> Column:
    v = parsed if parsed is not None else F.try_parse_json(raw)
    return (F.when(raw.isNull() | (strip_unicode(raw) == ""), F.lit(f"returned no structured {name} output"))
            .when(v.isNull(), F.lit(f"returned invalid {name} JSON"))
            .when(~F.schema_of_variant(v).startswith("OBJECT"), F.lit(f"returned an invalid {name} object")))


def json_kind(value: Column, path: str) -> Column:
    """Type name of the JSON value at ``path`` (null when absent)."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def _is_string_array(json_value: Column, path: str) -> Column:
    """The JSON value at ``path`` is an array whose items are all strings."""
    return F.coalesce(json_kind(json_value, path).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))


def question_rules(df: DataFrame, text_col: str = "output_text") -> DataFrame:
    """First failing rule, in the reference's order (null when the question is valid)."""
    raw = F.col("_json")
    p = F.col("parsed")
    qtype = p["question_type"]
    opts = F.coalesce(F.size(p["options"]), F.lit(0))
    exp = F.coalesce(F.size(p["expected_answer"]), F.lit(0))
    reason = (F.when(~F.coalesce(qtype.isin(*QUESTION_TYPES), F.lit(False)), F.lit("unsupported question type"))
              .when(~F.coalesce(json_kind(raw, "$.question") == "STRING", F.lit(False))
                    | (strip_unicode(p["question"]) == ""), F.lit("empty question"))
              .when(~_is_string_array(raw, "$.options"), F.lit("invalid question options"))
              .when(~_is_string_array(raw, "$.expected_answer") | (exp == 0), F.lit("invalid expected answer"))
              .when((qtype == "short_answer") & (opts > 0), F.lit("short-answer questions must not have options"))
              .when((qtype != "short_answer") & ~opts.between(2, 5),
                    F.lit("choice questions must have between 2 and 5 options"))
              .when((qtype == "single_choice") & (exp != 1),
                    F.lit("single-choice questions must have one expected answer")))
    return df.withColumn("rule_error", F.when(F.col("parse_error").isNull(), reason))


def output_errors(reason: Column) -> list[tuple[str, Column]]:
    """Every error of parsing and of the question rules, with the condition that an output has it."""
    parse = [f"returned {x}" for x in ("no structured test_question output", "invalid test_question JSON", "an invalid test_question object")]
    rules = ["unsupported question type", "empty question", "invalid question options", "invalid expected answer",
             "short-answer questions must not have options", "choice questions must have between 2 and 5 options",
             "single-choice questions must have one expected answer"]
    return [(name, F.coalesce(reason == name, F.lit(False))) for name in (*parse, *rules)]


def _score(judged: Column, field: str) -> Column:
    """JSON integer in 1..5, else null (booleans, fractions and strings are rejected)."""
    n = F.when(json_kind(judged, f"$.{field}") == "BIGINT", F.try_variant_get(judged, f"$.{field}", "int"))
    return F.when(n.between(1, 5), n)


def quality_gate(df: DataFrame, judge_col: str = "judge_text", threshold: float = DEFAULT_PASS_THRESHOLD) -> DataFrame:
    """Four judge scores -> overall mean, passed flag, status passed / failed / error."""
    check_gate_config(threshold, 1)
    raw = F.col(judge_col)
    judged = F.col("_judged")  # one parse feeds the error, the scores and the explanations
    parsed = (df.withColumn("_judged", F.try_parse_json(raw))
              .withColumn("judge_parse_error", _parse_error(raw, "question_quality_judge", judged)))
    parsed = parsed.withColumns({f: _score(judged, f) for f in SCORE_FIELDS})
    parsed = parsed.withColumns({f: F.coalesce(F.try_variant_get(judged, f"$.{f}", "string"), F.lit(""))
                                 for f in EXPLANATION_FIELDS})
    first_bad = F.coalesce(*[F.when(F.col(f).isNull(), F.lit(f"returned an invalid {f}")) for f in SCORE_FIELDS])
    judge_error = F.coalesce(F.col("judge_parse_error"), first_bad)
    overall = sum(F.col(f) for f in SCORE_FIELDS) / F.lit(4.0)
    return (parsed.withColumn("judge_error", judge_error)
            .withColumn("overall_score", F.when(F.col("judge_error").isNull(), overall))
            .withColumn("passed", F.coalesce(F.col("overall_score") >= F.lit(float(threshold)), F.lit(False)))
            .withColumn("judge_status", F.when(F.col("judge_error").isNotNull(), F.lit("error"))
                        .when(F.col("passed"), F.lit("passed")).otherwise(F.lit("failed")))
            .drop("judge_parse_error", "_judged"))


def _text_key(text_col: str) -> Column:
    """SHA-256 of the normalised question: texts of any length meet by 32 bytes, not as shuffle keys."""
    return F.unhex(F.sha2(normalize_question_text(F.col(text_col)), 256))


def history_dedup(attempts: DataFrame, history: DataFrame, session_col: str = "session_id",
                  text_col: str = "question_text") -> DataFrame:
    """Attempts whose normalised question is not already in the session's history (anti join)."""
    a = attempts.withColumn("_norm", _text_key(text_col))
    h = history.select(session_col, _text_key(text_col).alias("_norm")).distinct()
    return a.join(h, [session_col, "_norm"], "left_anti").drop("_norm")


def mark_duplicates(attempts: DataFrame, history: DataFrame, session_col: str = "session_id",
                    text_col: str = "question_text") -> DataFrame:
    """Same as ``history_dedup`` but keeps every attempt with an ``is_duplicate`` flag."""
    h = (history.select(session_col, _text_key(text_col).alias("_norm")).distinct()
         .withColumn("_dup", F.lit(True)))
    return (attempts.withColumn("_norm", _text_key(text_col))
            .join(h, [session_col, "_norm"], "left")
            .withColumn("is_duplicate", F.coalesce(F.col("_dup"), F.lit(False))).drop("_norm", "_dup"))


def reject_message(threshold: float) -> Column:
    """The judge-rejection text of one attempt (score rounded half-even, as Python formats it)."""
    summary = F.concat_ws(", ", *[F.format_string(f"{f.removesuffix('_score')}=%d/5", F.col(f))
                                  for f in SCORE_FIELDS])
    expl = F.concat_ws("; ", *[F.concat(F.lit(f"{lab}: "), F.col(f))
                               for lab, f in zip(SCORE_LABELS, EXPLANATION_FIELDS)])
    return F.format_string(f"Quality judge rejected attempt %d: overall score %.1f/5 (required {threshold:.1f}); %s. %s",
                           F.col("attempt_number"), F.bround(F.col("overall_score"), 1), summary, expl)


def attempt_outcomes(attempts: DataFrame, threshold: float = DEFAULT_PASS_THRESHOLD) -> DataFrame:
    """Per attempt: ok flag and the error text it would raise (parse, rule, duplicate, judge)."""
    o = (attempts.withColumn("attempt_error", F.coalesce(
        F.col("parse_error"), F.col("rule_error"),
        F.when(F.col("is_duplicate"), F.lit("generated a duplicate question")),
        F.col("judge_error"),
        F.when(~F.col("passed"), reject_message(threshold)))))
    return o.withColumn("ok", F.col("attempt_error").isNull())


def attempts_run(outcomes: DataFrame, slot_cols: list[str],
                 max_attempts: int = DEFAULT_MAX_ATTEMPTS) -> DataFrame:
    """The attempts a slot really makes: up to the limit, and none after the first that passes."""
    o = outcomes.where(F.col("attempt_number").between(1, max_attempts))
    earlier = Window.partitionBy(*slot_cols).orderBy("attempt_number").rangeBetween(Window.unboundedPreceding, -1)
    return (o.withColumn("_done", F.coalesce(F.bool_or("ok").over(earlier), F.lit(False)))
            .where(~F.col("_done")).drop("_done"))


def first_passing_attempt(outcomes: DataFrame, slot_cols: list[str],
                          max_attempts: int = DEFAULT_MAX_ATTEMPTS) -> DataFrame:
    """One row per question slot: the first passing attempt, else the last attempt's error.

    ``attempts_made`` ends with the passing attempt: later rows of the slot were never asked for.
    """
    o = attempts_run(outcomes, slot_cols, max_attempts)
    return (o.groupBy(*slot_cols)
            .agg(F.min(F.when(F.col("ok"), F.col("attempt_number"))).alias("passing_attempt"),
                 F.max_by("attempt_error", "attempt_number").alias("last_error"),
                 F.count(F.lit(1)).alias("attempts_made"))
            .withColumn("passed", F.col("passing_attempt").isNotNull())
            .withColumn("error", F.when(~F.col("passed"),
                                        F.concat(F.lit("Could not generate a quality-approved question: "),
                                                 F.col("last_error"))))
            .drop("last_error"))


def judgment_audit(outcomes: DataFrame, slot_cols: list[str],
                   max_attempts: int = DEFAULT_MAX_ATTEMPTS) -> DataFrame:
    """Audit rows of the attempts made: every judged attempt (passed / failed) plus attempts that
    reached the judge step and failed there or were duplicates (status error, no scores and no
    explanations).  No row when parsing or the question rules failed first."""
    reached = F.col("parse_error").isNull() & F.col("rule_error").isNull()
    status = F.when(F.col("is_duplicate"), F.lit("error")).otherwise(F.col("judge_status"))
    rows = attempts_run(outcomes, slot_cols, max_attempts).where(reached).withColumn("judge_status", status)
    judged = F.col("judge_status") != "error"
    return rows.withColumns({
        **{c: F.when(judged, F.col(c)) for c in ("overall_score", *SCORE_FIELDS, *EXPLANATION_FIELDS)},
        "passed": F.when(F.col("judge_status") == "passed", F.lit(True)).otherwise(F.lit(False))})


def _norm_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(c, lambda x: F.lower(strip_unicode(x)))))


def grade_choice(df: DataFrame, selected_col: str = "selected", expected_col: str = "expected_answer") -> DataFrame:
    """Choice grading: exact set match, ignoring case and surrounding whitespace; blank answers rejected."""
    blank = F.size(F.filter(F.col(selected_col), lambda x: strip_unicode(x) != "")) == 0
    return (df.withColumn("answer_error", F.when(F.col(selected_col).isNull() | blank,
                                                 F.lit("user_answer must be a non-empty string")))
            .withColumn("is_correct", F.when(F.col("answer_error").isNull(),
                                             _norm_set(F.col(selected_col)) == _norm_set(F.col(expected_col)))))


def grade_short(df: DataFrame, answer_col: str = "user_answer", expected_col: str = "expected_answer",
                similarity_col: str | None = None, threshold: float = 0.8) -> DataFrame:
    """Short answers: normalised exact match to any expected answer, else (optionally) an
    embedding similarity at or above ``threshold`` -- a deterministic stand-in for the model grader."""
    norm_answer = normalize_question_text(F.col(answer_col))
    exact = F.exists(F.col(expected_col), lambda e: normalize_question_text(e) == norm_answer)
    ok = exact if similarity_col is None else (exact | F.coalesce(F.col(similarity_col) >= threshold, F.lit(False)))
    blank = F.col(answer_col).isNull() | (strip_unicode(F.col(answer_col)) == "")
    return (df.withColumn("answer_error", F.when(blank, F.lit("user_answer must be a non-empty string")))
            .withColumn("is_correct", F.when(~blank, ok)))


def grade_records(df: DataFrame, text_col: str = "grade_text") -> DataFrame:
    """Model grade output: parsed, and rejected unless ``is_correct`` is a JSON boolean."""
    g = parse_outputs(df, text_col, GRADE_SCHEMA, "answer_grade")
    is_boolean = F.coalesce(json_kind(F.col("_json"), "$.is_correct") == "BOOLEAN", F.lit(False))
    return g.withColumn("grade_error", F.coalesce(
        F.col("parse_error"),
        F.when(~is_boolean, F.lit("returned an invalid correctness value"))))
