"""Question bank: inclusive threshold, batch abort, MIS rounds equal the sequential fold."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import bank as bk


def _vec(angle):
    return [math.cos(angle), math.sin(angle)]


def _records(spark, rows):
    return spark.createDataFrame(rows, "candidate_id long, question struct<question_type:string,question:string,"
                                       "options:array<string>,expected_answer:array<string>,explanation:string>, "
                                       "generation_difficulty int, source_paths array<string>, embedding array<float>")


def _q(text):
    return ("short_answer", text, [], ["x"], "e")


def test_threshold_is_inclusive(spark):
    # Integer vectors give exact cosines: 19/20 = 0.95 (skip), 18/20 = 0.9 (insert).
    bank = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 0.0])], "id long, embedding array<float>")
    cands = _records(spark, [(1, _q("a"), 3, ["p", "p", ""], [19.0, 5.0, 3.0, 2.0, 1.0]),
                             (2, _q("b"), 3, [], [18.0, 6.0, 6.0, 2.0, 0.0]),
                             (3, _q("c"), 3, None, [0.0, 0.0, 0.0, 0.0, 1.0])])
    v = {r.candidate_id: r.verdict for r in bk.bank_store(bk.normalize_records(cands), bank, 0.95).collect()}
    assert v == {1: "skipped", 2: "inserted", 3: "inserted"}
    stats = bk.bank_store_stats(bk.bank_store(bk.normalize_records(cands), bank, 0.95)).head()
    assert (stats.inserted, stats.skipped) == (2, 1)
    paths = bk.normalize_records(cands).where("candidate_id = 1").head().paths
    assert paths == ["p"]


def test_bad_difficulty_aborts_batch(spark):
    cands = _records(spark, [(1, _q("a"), 3, [], _vec(0.1)), (2, _q("b"), 6, [], _vec(1.0))])
    with pytest.raises(ValueError, match="difficulty"):
        bk.check_batch(bk.normalize_records(cands))
    blank = _records(spark, [(1, _q("   "), 3, [], _vec(0.1))])
    with pytest.raises(ValueError, match="non-empty"):
        bk.check_batch(bk.normalize_records(blank))


def _sequential(n, edges):
    nb = {}
    for a, b in edges:
        nb.setdefault(b, set()).add(a)
    kept = set()
    for v in range(n):
        if not (nb.get(v, set()) & kept):
            kept.add(v)
    return kept


def test_mis_rounds_equal_sequential(spark):
    rng = random.Random(7)
    verts, edges, expected = [], [], set()
    for g in range(60):
        n = rng.randint(1, 14)
        base = g * 100
        e = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.3]
        verts += [base + i for i in range(n)]
        edges += [(base + i, base + j) for i, j in e]
        expected |= {base + v for v in _sequential(n, e)}
    chain = [(1000000 + i, 1000000 + i + 1) for i in range(6)]  # a chain decides one link per round
    verts += [1000000 + i for i in range(7)]
    edges += chain
    expected |= {1000000 + i for i in range(0, 7, 2)}
    v = spark.createDataFrame([(x,) for x in verts], "vid long")
    e = spark.createDataFrame(edges, "src long, dst long")
    got = {r.vid for r in bk.first_independent_set(v, e).where("accepted").collect()}
    assert got == expected


def test_bank_list_page_and_total(spark):
    rows = [(i, "single_choice" if i % 2 else "short_answer", f"q{i}", [], [], "", [], i % 5 + 1)
            for i in range(30)]
    bank = (spark.createDataFrame(rows, "id long, question_type string, question_text string, options array<string>, "
                                        "correct_answer array<string>, explanation string, source_paths array<string>, "
                                        "difficulty int")
            .withColumn("created_at", F.lit("2024-01-01").cast("timestamp")))
    page = bk.bank_list(bank, "single_choice", None, 5).collect()
    assert [r.id for r in page] == [29, 27, 25, 23, 21]
    assert {r.total_count for r in page} == {15}
    with pytest.raises(ValueError):
        bk.bank_list(bank, limit=501)
    with pytest.raises(ValueError):
        bk.bank_list(bank, "essay")


def test_equal_vectors_join_once_and_equal_the_sequential_fold(spark):
    rng = random.Random(11)
    angles = [rng.choice([0.0, 0.2, 0.5, 0.9, 1.3]) for _ in range(60)]
    vectors = [None if i % 17 == 5 else [0.0, 0.0] if i % 19 == 7 else _vec(a) for i, a in enumerate(angles)]
    cands = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "candidate_id long, embedding array<double>")
    bank = spark.createDataFrame([], "id long, embedding array<double>")
    real = lambda v: v is not None and any(v)
    edges = [(a, b) for b in range(60) for a in range(b) if real(vectors[a]) and real(vectors[b])
             and sum(x * y for x, y in zip(vectors[a], vectors[b])) >= 0.95]
    got = {r.candidate_id for r in bk.bank_store(cands, bank, 0.95).where("verdict = 'inserted'").collect()}
    assert got == _sequential(60, edges)
    _, joined, copies = bk.duplicate_graph(cands, 0.95, "candidate_id", "embedding")
    assert copies.count() > 40 and joined.count() < 10


def test_long_batch_in_stretches_equals_the_sequential_fold(spark, monkeypatch):
    """Groups of similar records that begin in different stretches; no pair of a group decided earlier is listed again."""
    rng = random.Random(5)
    places = [rng.randrange(min(6, 1 + i // 2)) * 0.25 + rng.random() * 0.2 for i in range(240)]
    vectors = [None if i % 29 == 3 else [3 * x for x in _vec(a % 1.5)] for i, a in enumerate(places)]
    cands = spark.createDataFrame([(i * 10, v) for i, v in enumerate(vectors)], "candidate_id long, embedding array<double>").repartition(3)
    bank = spark.createDataFrame([(1, [-1.0, 0.0])], "id long, embedding array<double>")
    unit = [v and [x / math.hypot(*v) for x in v] for v in vectors]
    edges = [(a, b) for b in range(240) for a in range(b) if unit[a] and unit[b] and sum(x * y for x, y in zip(unit[a], unit[b])) >= 0.995]
    monkeypatch.setattr(bk, "STRETCH", 20)
    listed, join = [], bk.cosine_join
    monkeypatch.setattr(bk, "cosine_join", lambda *a, **k: (listed.append((r := join(*a, **k))[0].count()), r)[1])
    rows = bk.bank_store(cands, bank, 0.995).collect()
    assert {r.candidate_id // 10 for r in rows if r.verdict == "inserted"} == _sequential(240, edges) and len(rows) == 240
    assert len(listed) > 1 and sum(listed) < len(edges) / 4


def test_texts_of_the_batch_are_not_stored_again(spark, monkeypatch):
    stored, write = [], bk.write_table
    monkeypatch.setattr(bk, "write_table", lambda df, *a: (stored.append(df.columns), write(df, *a))[1])
    cands = spark.createDataFrame([(1, "text", [1.0, 0.0]), (2, "text", [1.0, 0.1])], "candidate_id long, question string, embedding array<double>")
    bank = spark.createDataFrame([], "id long, embedding array<double>")
    got = {r.candidate_id: (r.question, r.verdict) for r in bk.bank_store(cands, bank, 0.95).collect()}
    assert got == {1: ("text", "inserted"), 2: ("text", "skipped")} and not any("question" in c for c in stored)


def test_stats_of_a_batch_that_meets_the_bank_in_blocks(spark, monkeypatch):
    """Records whose only similar bank record lies in another block than their own are skipped too."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "23"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        plan = bk.vector_topk
        monkeypatch.setattr(bk, "vector_topk", lambda *a, **k: plan(*a, **k, strategy="grid", grid_query_rows=6, grid_item_rows=6))
        vectors = [[float(j == i) for j in range(40)] for i in range(40)]
        cands = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "candidate_id long, embedding array<double>")
        bank = spark.createDataFrame([(i, vectors[i]) for i in range(25)], "id long, embedding array<double>")
        got = bk.bank_store_stats(bk.bank_store(cands, bank, 0.95)).head()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert (got.inserted, got.skipped) == (15, 25)


@pytest.mark.parametrize("bad", [{"question_type": "essay"}, {"difficulty": 0}, {"limit": 501}, {"limit": True}])
def test_list_filters_are_checked(bad):
    with pytest.raises(ValueError, match=next(iter(bad))):
        bk.check_list_args(**{"question_type": None, "difficulty": None, "limit": 5, **bad})
