"""Sessions: first write wins, first finish wins, counters, adaptive difficulty."""

import datetime

from quarry.operators import sessions as ss

T0 = datetime.datetime(2024, 1, 1)


def _answers(spark, rows):
    return spark.createDataFrame(rows, "session_id long, question_number int, is_correct boolean, answered_at timestamp, tb int")


def test_first_write_wins_and_counters(spark):
    a = _answers(spark, [(1, 1, True, T0, 0), (1, 1, False, T0 + datetime.timedelta(1), 0), (1, 2, False, T0, 0),
                         (2, 1, True, T0, 1), (2, 1, False, T0, 0)])
    first = ss.answers_first_wins(a, ["answered_at", "tb"])
    got = {(r.session_id, r.question_number): r.is_correct for r in first.collect()}
    assert got == {(1, 1): True, (1, 2): False, (2, 1): False}
    c = {r.session_id: (r.answered_questions, r.correct_answers) for r in ss.session_counters(first).collect()}
    assert c == {1: (2, 1), 2: (1, 0)}


def test_difficulty_path(spark):
    a = _answers(spark, [(1, 1, True, T0, 0), (1, 2, False, T0, 0),
                         (2, 1, True, T0, 0), (2, 2, True, T0, 0), (2, 3, True, T0, 0), (2, 4, True, T0, 0),
                         (3, 1, False, T0, 0), (3, 2, False, T0, 0), (3, 3, False, T0, 0), (3, 4, True, T0, 0)])
    p = {(r.session_id, r.question_number): (r.assigned_difficulty, r.next_difficulty)
         for r in ss.difficulty_path(a).collect()}
    assert [p[(1, 1)], p[(1, 2)]] == [(3, 4), (4, 3)]
    assert [p[(2, q)][1] for q in range(1, 5)] == [4, 5, 5, 5]
    assert [p[(3, q)][1] for q in range(1, 5)] == [2, 1, 1, 2]


def test_first_finish_wins(spark):
    f = spark.createDataFrame([(1, T0 + datetime.timedelta(2), True, False, 0), (1, T0, False, True, 1),
                               (1, T0, True, True, 0)],
                              "session_id long, finished_at timestamp, completed boolean, ended_early boolean, tiebreak int")
    r = ss.session_finish(f).head()
    assert (r.completed_at, r.completed, r.ended_early) == (T0, True, True)


def test_difficulty_prefix_scan_long_sessions(spark):
    import random
    rng = random.Random(5)
    rows, expected = [], {}
    for sess, n in ((1, 1500), (2, 37), (3, 1)):
        d = 3
        numbers = sorted(rng.sample(range(1, 5000), n))
        for qn in numbers:
            c = rng.random() < 0.6
            nxt = max(1, min(5, d + (1 if c else -1)))
            rows.append((sess, qn, c, T0, 0))
            expected[(sess, qn)] = (d, nxt)
            d = nxt
    got = {(r.session_id, r.question_number): (r.assigned_difficulty, r.next_difficulty)
           for r in ss.difficulty_path(_answers(spark, rows), block=8).collect()}
    assert got == expected
