"""Judge gate and attempt selection golden cases; grading rules."""

from quarry.operators import quality as q


def _judge(g, c, cl, d):
    return (f'{{"groundedness_score": {g}, "answer_correctness_score": {c}, "clarity_score": {cl}, '
            f'"difficulty_score": {d}, "groundedness_explanation": "ge", "answer_correctness_explanation": "ae", '
            f'"clarity_explanation": "ce", "difficulty_explanation": "de"}}')


QUESTION = ('{"question_type": "short_answer", "question": "Why?", "options": [], "expected_answer": ["x"], '
            '"explanation": "e"}')


def _run(spark, attempts, history=()):
    df = spark.createDataFrame(attempts, "slot_id long, session_id string, attempt_number int, question_text string, "
                                         "output_text string, judge_text string")
    h = spark.createDataFrame(list(history), "session_id string, question_text string")
    a = q.question_rules(q.parse_outputs(df))
    a = q.mark_duplicates(a, h)
    return q.first_passing_attempt(q.attempt_outcomes(q.quality_gate(a)), ["slot_id"]).collect()


def test_all_attempts_fail(spark):
    r = _run(spark, [(1, "s", n, "Why?", QUESTION, _judge(2, 2, 2, 2)) for n in (1, 2, 3)])[0]
    assert not r.passed and "overall score 2.0/5" in r.error and "required 4.0" in r.error


def test_second_attempt_wins(spark):
    r = _run(spark, [(1, "s", 1, "Why?", QUESTION, _judge(3, 3, 3, 3)), (1, "s", 2, "Why?", QUESTION, _judge(5, 5, 5, 5)),
                     (1, "s", 3, "Why?", QUESTION, _judge(5, 5, 5, 5))])[0]
    assert r.passed and r.passing_attempt == 2


def test_duplicate_is_regenerated(spark):
    dup = QUESTION.replace("Why?", "  what   IS the answer? ")
    r = _run(spark, [(1, "s", 1, "  what   IS the answer? ", dup, _judge(5, 5, 5, 5)),
                     (1, "s", 2, "Why?", QUESTION, _judge(5, 5, 5, 5))],
             history=[("s", "What is the answer?")])[0]
    assert r.passing_attempt == 2


def test_grading(spark):
    df = spark.createDataFrame([(1, [" A ", "b"], ["a", "B"]), (2, ["a"], ["a", "b"]), (3, [" "], ["a"])],
                               "id long, selected array<string>, expected_answer array<string>")
    got = {r.id: (r.is_correct, r.answer_error) for r in q.grade_choice(df).collect()}
    assert got[1] == (True, None) and got[2] == (False, None) and got[3][1] is not None
    s = spark.createDataFrame([(1, "  Paris ", ["paris"]), (2, "Lyon", ["paris"])],
                              "id long, user_answer string, expected_answer array<string>")
    assert {r.id: r.is_correct for r in q.grade_short(s).collect()} == {1: True, 2: False}


def test_json_types_are_checked(spark):
    rows = [(1, _judge('"5"', 5, 5, 5)), (2, _judge("true", 5, 5, 5)), (3, _judge(4.5, 5, 5, 5)),
            (4, _judge(6, 5, 5, 5)), (5, _judge(5, 5, 5, 5))]
    got = {r.n: (r.judge_status, r.groundedness_score) for r in
           q.quality_gate(spark.createDataFrame(rows, "n int, judge_text string")).collect()}
    assert got == {**{n: ("error", None) for n in (1, 2, 3, 4)}, 5: ("passed", 5)}
    outs = [(1, QUESTION.replace('"Why?"', "5")), (2, QUESTION.replace('"Why?"', '" "')), (3, QUESTION)]
    got = {r.n: r.rule_error for r in q.question_rules(q.parse_outputs(
        spark.createDataFrame(outs, "n int, output_text string"))).collect()}
    assert got == {1: "empty question", 2: "empty question", 3: None}
    grades = [(1, '{"is_correct": "true"}'), (2, '{"is_correct": true}'), (3, "{}"), (4, '{"is_correct": 1}')]
    got = {r.n: r.grade_error is None for r in q.grade_records(
        spark.createDataFrame(grades, "n int, grade_text string")).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False}


def test_audit_ends_with_the_passing_attempt(spark):
    attempts = [(1, "s", 1, "Old", QUESTION, _judge(5, 5, 5, 5)), (1, "s", 2, "Why?", QUESTION, _judge('"4"', 5, 5, 5)),
                (1, "s", 3, "Why?", QUESTION, _judge(5, 5, 5, 5)), (1, "s", 4, "Why?", QUESTION, _judge(1, 1, 1, 1))]
    df = spark.createDataFrame(attempts, "slot_id long, session_id string, attempt_number int, question_text string, "
                                         "output_text string, judge_text string")
    a = q.mark_duplicates(q.question_rules(q.parse_outputs(df)),
                          spark.createDataFrame([("s", "old")], "session_id string, question_text string"))
    o = q.attempt_outcomes(q.quality_gate(a))
    got = {r.attempt_number: (r.judge_status, r.clarity_score, r.overall_score)
           for r in q.judgment_audit(o, ["slot_id"], 4).collect()}
    assert got == {1: ("error", None, None), 2: ("error", None, None), 3: ("passed", 5, 5.0)}
    r = q.first_passing_attempt(o, ["slot_id"], 4).head()
    assert (r.passing_attempt, r.attempts_made) == (3, 3)
