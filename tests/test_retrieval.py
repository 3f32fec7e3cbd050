"""Topics, budgets, merge, schedules, context."""

from pyspark.sql import functions as F

from quarry.functions.text import normalize_question_text, parse_topics
from quarry.operators import retrieval as rt
from quarry.operators import schedule as sc


def test_parse_topics(spark):
    df = spark.createDataFrame([(" Python, PostgreSQL, , Docker, Python ",), (" ,  , ",)], "t string")
    got = [r.p for r in df.select(parse_topics(F.col("t")).alias("p")).collect()]
    assert got == [["Python", "PostgreSQL", "Docker"], []]


def test_normalize_question(spark):
    df = spark.createDataFrame([("  what   IS the answer? ",), ("What is the answer?",)], "t string")
    a, b = [r.n for r in df.select(normalize_question_text(F.col("t")).alias("n")).collect()]
    assert a == b == "what is the answer?"


def test_budget(spark):
    s = spark.createDataFrame([(1, ["a", "b"], 5), (2, ["a", "b", "c"], 2)], "session_id long, topics array<string>, n int")
    t = rt.explode_topics(s)
    got = sorted((r.session_id, r.topic_pos, r.lim) for r in t.select("session_id", "topic_pos",
                                                                      rt.topic_budget(t, "n", 5).alias("lim")).collect())
    assert got == [(1, 0, 3), (1, 1, 2), (2, 0, 1), (2, 1, 1), (2, 2, 0)]


def test_merge_shared_chunk(spark):
    hits = spark.createDataFrame(
        [(1, 0, "first", 1, "a", 0, "x", 0.9), (1, 0, "first", 2, "a", 1, "y", 0.8), (1, 0, "first", 3, "b", 0, "z", 0.7),
         (1, 1, "second", 1, "a", 1, "y", 0.95), (1, 1, "second", 2, "c", 0, "w", 0.6), (1, 1, "second", 3, "c", 1, "v", 0.5)],
        "session_id long, topic_pos int, topic string, rank int, source_path string, chunk_index int, content string, "
        "similarity double")
    m = {(r.source_path, r.chunk_index): r for r in rt.merge_by_identity(hits).collect()}
    assert len(m) == 5
    assert m[("a", 1)].matched_topics == ["first", "second"] and m[("a", 1)].similarity == 0.8


def test_round_robin_and_single_chunk(spark):
    chunks = spark.createDataFrame([(1, 0, "a", 0), (1, 1, "a", 1), (1, 2, "b", 0), (2, 0, "a", 0)],
                                   "session_id long, chunk_pos int, source_path string, chunk_index int")
    counts = spark.createDataFrame([(1, 8), (2, 10), (3, 4)], "session_id long, requested int")
    s = sc.round_robin_schedule(chunks, counts).collect()
    one = [(r.source_path, r.chunk_index) for r in sorted([r for r in s if r.session_id == 1], key=lambda r: r.slot)]
    assert one == [("a", 0), ("a", 1), ("b", 0)] * 2 + [("a", 0), ("a", 1)]
    assert len([r for r in s if r.session_id == 2]) == 2
    assert not [r for r in s if r.session_id == 3]


def test_random_schedule_invariants(spark):
    chunks = spark.createDataFrame([(s, i, f"p{i}", 0) for s in range(30) for i in range(3)],
                                   "session_id long, chunk_pos int, source_path string, chunk_index int")
    counts = spark.createDataFrame([(s, 6) for s in range(30)], "session_id long, requested int")
    rr = sc.round_robin_schedule(chunks, counts)
    out = sc.random_schedule(rr, seed=1).collect()
    for s in range(30):
        rows = sorted([r for r in out if r.session_id == s], key=lambda r: r.position)
        keys = [r.source_path for r in rows]
        assert sorted(keys) == sorted(["p0", "p1", "p2"] * 2)
        assert all(a != b for a, b in zip(keys, keys[1:]))


def test_context_block(spark):
    df = spark.createDataFrame([(1, 1, ["t1", "t2"], "s.md", "body"), (1, 2, ["t1"], "u.md", "more")],
                               "session_id long, order int, matched_topics array<string>, source_path string, content string")
    ctx = rt.context_assembly(df).head().context
    assert ctx == "Topics: t1, t2\nSource: s.md\nbody\n\nTopics: t1\nSource: u.md\nmore"


def test_multi_topic_hybrid_limits_each_topic(spark):
    from quarry.operators.embedding import embed_hashing
    chunks = [(f"d{i}", 0, f"{w} text number {i}") for i, w in enumerate(["river delta", "river silt", "wind sail", "wind kite", "moon"])]
    index = embed_hashing(spark.createDataFrame(chunks, "source_path string, chunk_index int, content string"), "content")
    sessions = spark.createDataFrame([(1, ["river", "wind"], 3), (2, ["moon"], 1)], "session_id long, topics array<string>, n int")
    out = rt.multi_topic_retrieve(index, sessions, total_col="n", topic_vector_fn=lambda df, c: embed_hashing(df, c),
                                  mode="hybrid").orderBy("session_id", "order").collect()
    assert [(r.session_id, r.matched_topics, r.first_rank) for r in out] == [
        (1, ["river"], 1), (1, ["river"], 2), (1, ["wind"], 1), (2, ["moon"], 1)]
    assert {r.source_path for r in out if r.matched_topics == ["river"]} == {"d0", "d1"}
    assert all(r.lexical_score > 0 and r.vector_similarity > 0 for r in out)
