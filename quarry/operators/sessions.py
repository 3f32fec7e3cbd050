"""Test sessions and answers: state fold, counters and the performance dashboard
(OP-S10, OP-M2..M5, OP-J1, OP-J7, OP-J8, OP-A7..A12, OP-T5, OP-V6, OP-D4, OP-D6).

The reference keeps one row per session and updates it per event; here the
session table is *derived* from three event tables (starts, answers,
finishes) in one job, so it can be rebuilt from the logs at any time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.accounting import time_filter

# Fixed values from the reference: adaptive difficulty starts at 3, moves by one
# per answer and stays within 1..5.
START_DIFFICULTY = 3
MIN_DIFFICULTY = 1
MAX_DIFFICULTY = 5

SESSION_COLUMNS = ("id", "anonymous_session_id", "started_at", "completed_at", "topics",
                   "requested_questions", "answered_questions", "correct_answers",
                   "completed", "ended_early")


def answers_first_wins(answers: DataFrame, order_cols: list[str]) -> DataFrame:
    """``ON CONFLICT (session_id, question_number) DO NOTHING``: the earliest write wins.

    ``order_cols`` must make the order total within a key (e.g. answered_at, then a
    tiebreak).  A ``min_by`` aggregate is combined map-side, so a key repeated by a
    third of all rows is reduced before the shuffle instead of landing in one task.
    """
    keys = ["session_id", "question_number"]
    rest = [c for c in answers.columns if c not in keys]
    first = (answers.groupBy(*keys)
             .agg(F.min_by(F.struct(*rest), F.struct(*order_cols)).alias("_first")))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*answers.columns)


def session_counters(answers: DataFrame) -> DataFrame:
    """answered / correct per session (decorrelated form of the two scalar subqueries)."""
    return (answers.groupBy("session_id")
            .agg(F.count(F.lit(1)).alias("answered_questions"),
                 F.count_if(F.col("is_correct")).alias("correct_answers")))


def session_finish(finishes: DataFrame) -> DataFrame:
    """First finish wins (``WHERE completed_at IS NULL``): earliest event per session."""
    ev = F.struct("finished_at", "_tiebreak", "completed", "ended_early")
    return (finishes.withColumn("_tiebreak", F.col("tiebreak"))
            .groupBy("session_id")
            .agg(F.min_by(ev, F.struct("finished_at", "_tiebreak")).alias("_f"))
            .select("session_id", F.col("_f.finished_at").alias("completed_at"),
                    F.col("_f.completed").alias("completed"), F.col("_f.ended_early").alias("ended_early")))


def sessions_build(starts: DataFrame, answers: DataFrame, finishes: DataFrame) -> DataFrame:
    """Session state = start row, left-joined with counters and first finish."""
    counters = session_counters(answers)
    fin = session_finish(finishes)
    s = (starts.join(counters, starts.id == counters.session_id, "left").drop("session_id")
         .join(fin, starts.id == fin.session_id, "left").drop("session_id"))
    return s.select(
        "id", "anonymous_session_id", "started_at", "completed_at", "topics", "requested_questions",
        F.coalesce("answered_questions", F.lit(0)).cast("long").alias("answered_questions"),
        F.coalesce("correct_answers", F.lit(0)).cast("long").alias("correct_answers"),
        F.coalesce("completed", F.lit(False)).alias("completed"),
        F.coalesce("ended_early", F.lit(False)).alias("ended_early"),
    )


def orphan_answers(answers: DataFrame, sessions: DataFrame) -> DataFrame:
    """FK check ``test_answers.session_id -> test_sessions.id``: answers with no session."""
    return answers.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_anti")


def _pct(num: Column, den: Column) -> Column:
    return F.lit(100.0) * num.cast("double") / F.nullif(den, F.lit(0)).cast("double")


def tests_started(sessions: DataFrame, start, end) -> DataFrame:
    return time_filter(sessions, "started_at", start, end).agg(F.count(F.lit(1)).alias("value"))


def overall_accuracy(sessions: DataFrame, start, end) -> DataFrame:
    s = time_filter(sessions, "started_at", start, end)
    return s.agg(F.coalesce(_pct(F.sum("correct_answers"), F.sum("answered_questions")), F.lit(0.0))
                 .alias("value"))


def accuracy_over_time(sessions: DataFrame, start, end) -> DataFrame:
    s = time_filter(sessions, "started_at", start, end).where(F.col("answered_questions") > 0)
    return s.select(F.col("started_at").alias("time"), "id",
                    _pct(F.col("correct_answers"), F.col("answered_questions")).alias("accuracy_percent")
                    ).orderBy("time", "id")


def accuracy_by_difficulty(answers: DataFrame, sessions: DataFrame, start, end) -> DataFrame:
    a = time_filter(answers, "answered_at", start, end)
    joined = a.join(sessions.select("id"), a.session_id == sessions.id, "inner")
    return (joined.groupBy("assigned_difficulty")
            .agg(F.count(F.lit(1)).alias("answered"),
                 (F.lit(100.0) * F.avg(F.when(F.col("is_correct"), 1).otherwise(0))).alias("accuracy_percent"))
            .orderBy("assigned_difficulty")
            .select(F.col("assigned_difficulty").cast("string").alias("difficulty"), "answered",
                    "accuracy_percent"))


def round_half_up_pct(num: Column, den: Column) -> Column:
    """ROUND(100.0 * num / den, 1) with exact half-up rounding in integer arithmetic."""
    n = num.cast("long")
    d = F.nullif(den.cast("long"), F.lit(0))
    return F.floor((F.lit(2000) * n + d) / (F.lit(2) * d)).cast("double") / F.lit(10.0)


def recent_sessions(sessions: DataFrame, start, end, limit: int = 100) -> DataFrame:
    """Newest ``limit`` sessions; the limit is the dashboard feature (top-k report)."""
    s = time_filter(sessions, "started_at", start, end)
    return (s.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(limit)
            .select("id", "anonymous_session_id", "started_at", "completed_at", "topics",
                    "requested_questions", "answered_questions", "correct_answers",
                    round_half_up_pct(F.col("correct_answers"), F.col("answered_questions"))
                    .alias("accuracy_percent"),
                    "completed", "ended_early"))


def test_summary(sessions: DataFrame) -> DataFrame:
    """Final score per test: correct / answered / requested, ended early."""
    return sessions.select(F.col("id").alias("session_id"), F.col("correct_answers").alias("correct"),
                           F.col("answered_questions").alias("answered"),
                           F.col("requested_questions").alias("requested"), "ended_early")


def constraint_report(answers: DataFrame, sessions: DataFrame) -> DataFrame:
    """Declared table constraints as rule counts (parquet enforces none)."""
    a = answers.agg(
        F.count_if(~(F.col("question_number") > 0)).alias("answers_question_number_positive"),
        F.count_if(~F.col("assigned_difficulty").between(1, 5)).alias("answers_assigned_difficulty_range"),
        F.count_if(~F.col("next_difficulty").between(1, 5)).alias("answers_next_difficulty_range"),
        F.count_if(F.col("is_correct").isNull()).alias("answers_is_correct_not_null"),
    )
    dup = (answers.groupBy("session_id", "question_number").agg(F.count(F.lit(1)).alias("n"))
           .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("answers_unique_session_question")))
    s = sessions.agg(
        F.count_if(~(F.col("requested_questions") > 0)).alias("sessions_requested_positive"),
        F.count_if(~(F.col("answered_questions") >= 0)).alias("sessions_answered_non_negative"),
        F.count_if(~(F.col("correct_answers") >= 0)).alias("sessions_correct_non_negative"),
    )
    orphans = orphan_answers(answers, sessions).agg(F.count(F.lit(1)).alias("answers_session_fk"))
    out = None
    for one_row in (a, dup, s, orphans):
        stack = "stack({}, {}) as (rule, violations)".format(
            len(one_row.columns), ", ".join(f"'{n}', cast({n} as bigint)" for n in one_row.columns))
        part = one_row.selectExpr(stack)
        out = part if out is None else out.unionByName(part)
    return out


def _compose(members):
    """Tables applied in member order: result[s] = state after all members, from state s."""
    start = F.array(*[F.lit(v) for v in range(MIN_DIFFICULTY, MAX_DIFFICULTY + 1)])
    return F.aggregate(members, start, lambda acc, m: F.transform(acc, lambda x: F.element_at(m["table"], x)))


def _entries(members, entry):
    """Entry state of every member of a group, given the group's entry state."""
    init = F.struct(entry.alias("state"), F.array().cast("array<struct<member:bigint,entry:int>>").alias("out"))
    return F.aggregate(
        members, init,
        lambda acc, m: F.struct(F.element_at(m["table"], acc["state"]).alias("state"),
                                F.concat(acc["out"], F.array(F.struct(m["member"].cast("long").alias("member"),
                                                                      acc["state"].alias("entry")))).alias("out")),
        lambda acc: acc["out"])


def difficulty_path(answers: DataFrame, block: int = 256) -> DataFrame:
    """Adaptive difficulty per answer: start 3, +1 when correct, -1 when wrong, clamp 1..5.

    A segmented parallel prefix scan: each answer is a transition table over the five
    states; tables are composed in groups of at most ``block`` (question-number
    ranges, so no window over a whole session), level by level, then entry states
    are pushed back down.  No group ever holds more than ``block`` items, however
    long a session is.
    """
    from quarry.session import cut_lineage
    step = F.when(F.col("is_correct"), 1).otherwise(-1)
    table = F.array(*[F.greatest(F.lit(MIN_DIFFICULTY), F.least(F.lit(MAX_DIFFICULTY), F.lit(v) + step))
                      for v in range(MIN_DIFFICULTY, MAX_DIFFICULTY + 1)])
    base = answers.select("session_id", F.col("question_number").cast("long").alias("member"), "is_correct",
                          table.alias("table"))
    top = base.agg(F.max("member").alias("m")).head()["m"] or 0
    levels = []
    cur = base.select("session_id", "member", "table")
    span = 1
    while True:
        grouped = (cur.withColumn("grp", F.floor(F.col("member") / block).cast("long"))
                   .groupBy("session_id", "grp")
                   .agg(F.sort_array(F.collect_list(F.struct("member", "table"))).alias("ms")))
        grouped = cut_lineage(grouped.withColumn("table", _compose(F.col("ms"))))
        levels.append(grouped)
        span *= block
        if top < span:
            break
        cur = grouped.select("session_id", F.col("grp").alias("member"), "table")
    # Downward pass: the single top group of a session enters at the start difficulty.
    entry = levels[-1].select("session_id", "grp", F.lit(START_DIFFICULTY).alias("entry"))
    for lvl in reversed(levels):
        e = (lvl.join(entry, ["session_id", "grp"])
             .select("session_id", F.explode(_entries(F.col("ms"), F.col("entry"))).alias("x"))
             .select("session_id", F.col("x.member").alias("grp"), F.col("x.entry").alias("entry")))
        entry = e
    out = entry.withColumnRenamed("grp", "member")
    res = base.join(out, ["session_id", "member"])
    return res.select("session_id", F.col("member").cast("int").alias("question_number"), "is_correct",
                      F.col("entry").alias("assigned_difficulty"),
                      F.element_at(F.col("table"), F.col("entry")).alias("next_difficulty"))


#: Characters that an item of the history takes beside its texts.
ITEM_OVERHEAD = 64


def history_items(turns: DataFrame, session: str = "session_id", order: str = "question_number", block: int = 1024) -> DataFrame:
    """Graded answers (session, question_number, question, answer, is_correct) with ``offset``, the characters of
    the session's history before each.

    Running sums in two levels (blocks of question numbers, then items of a block), so a session
    of any length is not gathered in one task."""
    size = F.coalesce(F.char_length("question"), F.lit(0)) + F.coalesce(F.char_length("answer"), F.lit(0)) + ITEM_OVERHEAD
    items = turns.withColumn("_size", size.cast("long")).withColumn("_block", F.floor(F.col(order) / block))
    sums = items.groupBy(session, "_block").agg(F.sum("_size").alias("_s"))
    before = Window.partitionBy(session).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(session, "_block", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(session, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (items.withColumn("_in", F.coalesce(F.sum("_size").over(within), F.lit(0))).join(base, [session, "_block"])
            .withColumn("offset", F.col("_base") + F.col("_in")).drop("_size", "_block", "_base", "_in"))


def running_history(items: DataFrame, budget: int, session: str = "session_id", order: str = "question_number", texts: bool = False) -> DataFrame:
    """History of each item by reference: ``first_item``, the earliest item whose history up to this one fits
    ``budget`` characters (null when none does), and ``n_items`` of them; with ``texts`` the list ``history`` of
    (question, answer, correct) itself, which is no longer than the budget.

    Items meet their history within two stretches of ``budget`` characters, so no window runs over a whole session."""
    part = F.floor(F.col("offset") / budget)
    both = items.withColumn("_part", F.explode(F.array(part, part + 1))).withColumn("_own", F.col("_part") == part)
    frame = Window.partitionBy(session, "_part").orderBy("offset").rangeBetween(-budget, -1)
    out = both.withColumn("first_item", F.min(order).over(frame)).withColumn("n_items", F.count(F.lit(1)).over(frame))
    if texts:
        out = out.withColumn("history", F.collect_list(F.struct("question", "answer", F.col("is_correct").alias("correct"))).over(frame))
    return out.where("_own").drop("_part", "_own")


def whole_history(turns: DataFrame, session: str = "session_id", order: str = "question_number", asked: str = "asked") -> DataFrame:
    """Every row of ``turns`` (question, answer, is_correct) with ``history``: all earlier rows that ask something, in
    order, as (question, answer, correct).  Nothing is cut; the list of a row grows with its session, as the prompt does."""
    earlier = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    item = F.struct("question", "answer", F.col("is_correct").alias("correct"))
    return turns.withColumn("history", F.collect_list(F.when(F.col(asked), item)).over(earlier))


def start_rows(starts: DataFrame) -> DataFrame:
    """Start events as rows of the session table: nothing answered, not finished (OP-S10)."""
    return starts.select("id", "anonymous_session_id", "started_at", F.lit(None).cast(starts.schema["started_at"].dataType).alias("completed_at"),
                         "topics", "requested_questions", F.lit(0).cast("long").alias("answered_questions"),
                         F.lit(0).cast("long").alias("correct_answers"), F.lit(False).alias("completed"), F.lit(False).alias("ended_early"))
