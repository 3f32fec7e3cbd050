"""History by reference against a plain walk, and the plan of the price join."""

import random

from quarry.operators import accounting, sessions

TURNS = "session_id long, question_number long, question string, answer string, is_correct boolean"


def test_ranges_and_texts(spark):
    r = random.Random(4)
    rows = [(s, n, "q" * r.randint(0, 60), None if n % 17 == 3 else "a" * r.randint(0, 90), n % 2 == 0)
            for s in range(6) for n in r.sample(range(400), 150 if s else 1)]
    items = sessions.history_items(spark.createDataFrame(rows, TURNS).repartition(4), block=16)
    got = {(x.session_id, x.question_number): x for x in sessions.running_history(items, 500, texts=True).collect()}
    assert len(got) == len(rows)
    for s in range(6):
        own = sorted(x for x in rows if x[0] == s)
        sizes = [len(x[2] or "") + len(x[3] or "") + 64 for x in own]
        for i, x in enumerate(own):
            first = i
            while first > 0 and sum(sizes[first - 1:i]) <= 500:
                first -= 1
            g = got[s, x[1]]
            assert (g.offset, g.n_items, g.first_item) == (sum(sizes[:i]), i - first, own[first][1] if first < i else None)
            assert [(h.question, h.answer, h.correct) for h in g.history] == [y[2:] for y in own[first:i]]


def test_prices_do_not_shuffle_the_log(spark):
    log = spark.createDataFrame([(f"r{i}", "2024-01-01", "op", f"m{i % 4}", '{"input_tokens": 5}') for i in range(50)],
                                "response_id string, created_at string, operation string, model string, usage_json string").repartition(4)
    plan = accounting.usage_cost(log, accounting.pricing_table(spark, '{"m0": {"input": 2, "cached_input": 1, "output": 8}}'))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(model" not in plan


def test_registered_history_is_whole(spark, tmp_path):
    from quarry.plans.catalog import QUERIES
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}-{t} " + "x" * 900) for c in range(3) for t in range(12) if (c, t) != (1, 5)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(x.conv_id, x.turn): x for x in QUERIES["running_history"](spark, str(tmp_path)).collect()}
    assert set(got) == {r[:2] for r in rows}  # every turn, also replies
    text = {r[:2]: r[3] for r in rows}
    for (c, t), x in got.items():
        asked = [u for u in range(0, t, 2)]
        assert x.history == [text[c, u] for u in asked]  # far beyond any budget
        assert x.answers == [text.get((c, u + 1)) for u in asked]
        assert x.correct == [None if (c, u + 1) not in text or (c + u) % 9 == 0 else (c + u) % 9 % 2 == 0 for u in asked]
