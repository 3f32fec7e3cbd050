"""Cells: the exact join equals brute force, the search finds what its probe list holds, cells stay bounded."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import cells
from quarry.operators.embedding import embed_hashing, hash_bucket, sparse_vectors
from quarry.operators.vector_search import _list_matrix, vector_topk


def clustered(n, dim=12, groups=9, seed=4):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] * 4 + rng.normal(size=(n, dim))
    v[3] = v[1]  # equal vectors
    v[5] = 0  # no direction
    return v.astype(np.float32)


def frame(spark, v, name="id"):
    rows = [(i, None if i == 7 else [float(x) for x in r]) for i, r in enumerate(v)]
    return spark.createDataFrame(rows, f"{name} bigint, embedding array<float>").repartition(4)


def cosines(a, b):
    a, b = a.astype(float), b.astype(float)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (a @ b.T) / np.sqrt((a * a).sum(1))[:, None] / np.sqrt((b * b).sum(1))


@pytest.mark.parametrize("threshold", [0.9, 0.2, -0.5])
def test_self_join_is_exact_and_once(spark, threshold):
    v = clustered(400)
    pairs, work = cells.cosine_join(frame(spark, v), None, threshold, left_id="id", right_id="other", n_cells=20, max_rows=37)
    got = [(r.id, r.other) for r in pairs.collect()]
    s = cosines(v, v)
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if s[i, j] >= threshold and 7 not in (i, j)}
    assert len(got) == len(set(got)) and set(got) == want
    scored = work.first().pairs_scored
    assert scored < 400 * 400 * (0.25 if threshold == 0.9 else 1)


def test_join_of_two_sides(spark):
    a, b = clustered(150, seed=1), clustered(260, seed=2)
    pairs, _ = cells.cosine_join(frame(spark, a, "x"), frame(spark, b, "y"), 0.6, left_id="x", right_id="y", n_cells=8, max_rows=20)
    s = cosines(a, b)
    got = {(r.x, r.y): r.similarity for r in pairs.collect()}
    assert set(got) == {(i, j) for i in range(150) for j in range(260) if s[i, j] >= 0.6 and i != 7 and j != 7}
    assert all(abs(got[k] - s[k]) < 1e-9 for k in got)


def test_similar_ids_are_those_of_the_join(spark):
    a, b = clustered(150, seed=1), clustered(260, seed=2)
    got = [r.x for r in cells.similar_ids(frame(spark, a, "x"), frame(spark, b, "y"), 0.9, left_id="x", right_id="y", n_cells=8, max_rows=40).collect()]
    s = cosines(a, b)
    s[7], s[:, 7] = -2, -2
    assert len(got) == len(set(got)) and set(got) == set(np.flatnonzero((np.nan_to_num(s, nan=-2) >= 0.9).any(axis=1)))
    assert cells.similar_ids(frame(spark, a, "x"), frame(spark, b, "y").limit(0), 0.9, left_id="x", right_id="y").count() == 0


def test_a_row_is_sent_once_a_block(spark):
    """1,000 rows in 4 blocks of about 250: 5 copies of each, not one for every cell within reach."""
    rows = frame(spark, clustered(1000))
    met, centroids = cells._join_sides(rows, None, "id", "embedding", "other", 40, 250)
    sent = met._gd1._df.count() + met._gd2._df.count()
    assert len(centroids) == 40 and sent == 999 * 5


def test_join_of_equal_and_no_vectors(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(90)], "id bigint, embedding array<float>")
    pairs, _ = cells.cosine_join(same, None, 0.95, left_id="id", right_id="other", max_rows=16)
    assert pairs.count() == pairs.distinct().count() == 90 * 89 // 2
    none, work = cells.cosine_join(same.limit(0), None, 0.95, left_id="id", right_id="other")
    assert none.count() == 0 and work.first().pairs_scored == 0


def test_search_finds_all_when_all_cells_are_probed(spark):
    v, q = clustered(500), clustered(40, seed=8)
    index = cells.build_cells(frame(spark, v), ["id"], n_cells=16, max_rows=25)
    assert index.rows.sum() == 498 and (index.rows / index.chunks <= 25).all()
    got = cells.search_cells(index, frame(spark, q, "query_id"), 5, probes=99, max_rows=9)
    s = cosines(q, v)
    s[:, [5, 7]] = -2
    want = {(i, r + 1, int(j)) for i in range(40) if i not in (5, 7) for r, j in enumerate(np.lexsort((np.arange(500), -s[i]))[:5])}
    assert {(r.query_id, r["rank"], r.id) for r in got.collect()} == want


def test_calibrated_probes_reach_the_recall(spark):
    v, q = clustered(2000, groups=40), clustered(100, groups=40, seed=9)
    index = cells.build_cells(frame(spark, v), ["id"], n_cells=40)
    queries = frame(spark, q, "query_id")
    probes = cells.calibrated_probes(index, queries, 0.95)
    assert 1 <= probes < 40
    got = {(r.query_id, r.id) for r in cells.search_cells(index, queries, 5, probes).collect()}
    s = cosines(q, v)
    s[:, [5, 7]] = -2
    true = {(i, int(j)) for i in range(100) if i not in (5, 7) for j in np.argsort(-s[i], kind="stable")[:5]}
    assert len(got & true) / len(true) >= 0.95
    scored = cells.search_cells(index, queries, 5, probes, counted=True).agg(F.sum("scored")).first()[0]
    assert scored < 0.9 * 98 * 1998


def test_search_of_nothing(spark):
    index = cells.build_cells(frame(spark, clustered(20)).limit(0), ["id"])
    q = frame(spark, clustered(9), "query_id")
    assert cells.search_cells(index, q).count() == 0 and cells.calibrated_probes(index, q) == 1


def test_rows_meet_the_centroids_in_slices():
    b = pa.record_batch([pa.array(range(1300))], ["x"])
    got = list(cells.slices(iter([b, b.slice(0, 0), b.slice(0, 5)])))
    assert [x.num_rows for x in got] == [512, 512, 276, 5]
    assert [v for x in got for v in x.column(0).to_pylist()] == [*range(1300), *range(5)]


def test_visits_go_out_in_bounded_batches(spark, monkeypatch):
    """Every row visits every chunk of every cell: each pair is there once, and no batch holds them all."""
    most, make = [0], pa.RecordBatch.from_arrays
    rows = spark.createDataFrame([(i, [float(i % 7 + 1), 1.0]) for i in range(600)], "id long, embedding array<float>").coalesce(1)
    monkeypatch.setattr(cells, "OUT_ROWS", 100)
    visits, _ = cells._visits(rows, "id", "embedding", lambda u, b: (np.ones((len(u), 3), bool), np.zeros((len(u), 3))), np.array([1, 2, 1]), 4096)
    assert visits.count() == visits.select("id", "cell", "chunk").distinct().count() == 600 * 4


def test_sparse_vectors_hold_the_same_numbers(spark):
    rows = [(0, [0.0, 1.5, 0.0, -2.0]), (1, None), (2, [0.0] * 4), (3, [float("nan"), 0.0, 3.0, 4.0])]
    got = sparse_vectors(spark.createDataFrame(rows, "id long, embedding array<float>").coalesce(1)).orderBy("id").toArrow()
    assert got["embedding"].is_null().to_pylist() == [False, True, False, False] and got["embedding"][0].as_py()["indices"] == [1, 3]
    held = got.filter(got["embedding"].is_valid())["embedding"].combine_chunks()
    for part, first in ((held, 0), (held.slice(1, 2), 1)):
        np.testing.assert_array_equal(_list_matrix(part, 4), np.array([rows[i][1] for i in (0, 2, 3)][first:first + len(part)]))
    assert _list_matrix(held, 4, as_stored=True).dtype == np.float32
    with pytest.raises(ValueError, match="dimension 4"):
        _list_matrix(held, 5)


def test_sparse_and_plain_index_give_the_same(spark):
    v, q = np.round(clustered(300)), np.round(clustered(30, seed=8))
    v[np.abs(v) < 3] = 0
    plain, queries = frame(spark, v), frame(spark, q, "query_id")
    sparse = sparse_vectors(plain.withColumn("hash", F.xxhash64("embedding")))
    a, b = (cells.build_cells(x, ["id"], n_cells=12, max_rows=25, hash_col=h) for x, h in ((plain, None), (sparse, "hash")))
    assert np.array_equal(a.centroids, b.centroids) and np.array_equal(a.rows, b.rows)
    assert [r[1:] for r in vector_topk(plain, queries, 4, key_cols=("id",), payload_cols=()).orderBy("query_id", "rank").collect()] == \
        [r[1:] for r in vector_topk(sparse, queries, 4, key_cols=("id",), payload_cols=()).orderBy("query_id", "rank").collect()]
    # the queries sent to the rows, and met by cell, in blocks
    want = sorted(cells.search_cells(a, queries, 4, probes=5, max_rows=9, max_broadcast_bytes=0).collect())
    assert want and want == sorted(cells.search_cells(a, queries, 4, probes=5).collect())
    assert want == sorted(cells.search_cells(b, queries, 4, probes=5).collect())
    assert want == sorted(cells.search_cells(b, queries, 4, probes=5, max_rows=9, max_broadcast_bytes=0).collect())


def test_a_search_by_few_queries_does_not_shuffle_the_rows(spark):
    index = cells.build_cells(frame(spark, clustered(200)), ["id"], n_cells=8)
    found = cells.search_cells(index, frame(spark, clustered(10, seed=8), "query_id"), 5, probes=3)
    assert "FlatMapCoGroupsInArrow" not in found._jdf.queryExecution().toString()


def test_only_the_least_hashes_are_sorted_for_training(spark, monkeypatch):
    """The centroids are those of the sample of least hash, and no task sorts vectors far beyond it."""
    v = np.random.default_rng(3).normal(size=(6000, 6)).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<float>").repartition(8)
    drawn = rows.withColumn("h", F.xxhash64("embedding")).orderBy("h").limit(100).toArrow()
    points = cells.unit(_list_matrix(drawn["embedding"], 6))
    sorted_rows, order = [], type(rows).orderBy
    monkeypatch.setattr(type(rows), "orderBy", lambda df, *c: sorted_rows.append(df.count()) or order(df, *c))
    got = cells.train_cells(rows, "embedding", 9, sample=100)
    np.testing.assert_allclose(got, cells.kmeans(points, 9))
    assert 100 <= sorted_rows[0] < 200
    monkeypatch.undo()
    everything = cells.train_cells(rows.limit(50), "embedding", 9, sample=100)
    assert everything.shape == (9, 6)


def test_single_precision_decides_no_near_tie(monkeypatch):
    rng = np.random.default_rng(5)
    c = cells.unit(rng.normal(size=(64, 20)))
    c[1] = cells.unit(c[:1] + 1e-5 * rng.normal(size=(1, 20)))[0]  # one in single precision
    c[9] = c[8]  # equal: the first counts
    u = cells.unit(np.concatenate([c[[0, 1, 8, 9]], rng.normal(size=(500, 20)), c[:2] + 1e-5 * rng.normal(size=(2, 20))]))
    for tied in (16, 0):
        monkeypatch.setattr(cells, "TIED", tied)
        cell, cosine = cells.nearest(u, c, c.astype(np.float32))
        s = u @ c.T
        np.testing.assert_allclose(s[np.arange(len(u)), cell], s.max(axis=1), rtol=0, atol=1e-15)
        assert cell[:4].tolist() == [0, 1, 8, 8]
        np.testing.assert_allclose(cosine, s.max(axis=1), rtol=0, atol=1e-15)
    assert [len(x) for x in cells.nearest(u[:0], c, c.astype(np.float32))] == [0, 0]


def test_a_cell_has_few_files(spark):
    """Chunks bound what meets in a task; they are not files of their own."""
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(400)], "id bigint, embedding array<float>")
    index = cells.build_cells(same, ["id"], n_cells=1, max_rows=10)
    assert index.chunks.tolist() == [40] and index.table.select("chunk").distinct().count() > 30
    assert len(index.table.inputFiles()) <= 40 // cells.FILE_CHUNKS


def test_words_hash_as_one_by_one(spark):
    text = "one two é日本 " + "x" * 300
    got = embed_hashing(spark.createDataFrame([(text,), (None,), ("",)], "t string"), "t", dim=16).select("embedding").collect()
    want = [0.0] * 16
    for w in text.split():
        want[hash_bucket(w, 16)] += 1
    assert [r[0] for r in got] == [want, None, [0.0] * 16]


def test_calibration_counts_the_rows_of_the_exact_search(spark):
    """Of equally near rows in two cells the one of the smaller key is meant, as in the exact search."""
    index = cells.build_cells(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "id bigint, embedding array<float>"), ["id"], n_cells=2)
    for first, near in ((0, 1e-12), (0, -1e-12)):
        q = spark.createDataFrame([(5, [1.0, 1.0])], "query_id long, embedding array<float>")
        home = int(index.table.where(f"id = {first}").first()["cell"])
        index.centroids = index.centroids + np.array([[near], [-near]]) * (1 if home else -1)
        place = np.argsort(-(cells.unit(np.ones((1, 2))) @ index.centroids.T)[0], kind="stable").tolist().index(home)
        assert cells.calibrated_probes(index, q, 1.0, 1) == place + 1


def test_equal_rows_without_a_key_come_first(spark):
    """Once they are among the first of a chunk: there, keys come before nulls."""
    rows = [(f"{i:02d}" if i % 4 else None, i, [1.0, float(i % 2 + 1), float(i % 2)]) for i in range(40)]
    index = cells.build_cells(spark.createDataFrame(rows, "a string, b int, embedding array<float>").repartition(5), ["a", "b"], n_cells=2)
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    for k, want in ((22, [(None, b) for b in range(0, 40, 4)] + [(f"{b:02d}", b) for b in range(2, 40, 4)]), (5, [(f"{b:02d}", b) for b in range(2, 22, 4)])):
        for limit in (0, 1 << 20):
            got = cells.search_cells(index, q, k, probes=2, max_broadcast_bytes=limit).orderBy("rank").collect()
            assert [(r.a, r.b) for r in got][:20] == want
