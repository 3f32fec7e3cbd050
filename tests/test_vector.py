"""Exact top-k: broadcast and grid plans equal a numpy brute force; theta join; dimension check."""

import numpy as np
import pyarrow as pa
import pytest

from quarry.operators import embedding, vector_search
from quarry.operators.vector_search import vector_topk


def _data(spark, n_items=300, n_q=40, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    items = rng.normal(size=(n_items, dim))
    items[5] = items[7]            # exact duplicate vectors tie
    items[9] = 0.0                 # zero vector never scores
    qs = rng.normal(size=(n_q, dim))
    idx = spark.createDataFrame([(f"p{i % 7}", i, f"c{i}", [float(x) for x in v]) for i, v in enumerate(items)],
                                "source_path string, chunk_index int, content string, embedding array<float>")
    q = spark.createDataFrame([(j, [float(x) for x in v]) for j, v in enumerate(qs)],
                              "query_id long, embedding array<float>")
    return idx, q, items.astype(np.float32).astype(np.float64), qs.astype(np.float32).astype(np.float64)


def _brute(items, qs, k):
    out = {}
    norms = np.linalg.norm(items, axis=1)
    for j, qv in enumerate(qs):
        sims = []
        for i, v in enumerate(items):
            if norms[i] == 0:
                continue
            sims.append((-(qv @ v) / (np.linalg.norm(qv) * norms[i]), f"p{i % 7}", i))
        sims.sort()
        out[j] = [(s[1], s[2]) for s in sims[:k]]
    return out


@pytest.mark.parametrize("strategy", ["broadcast", "grid"])
def test_topk_matches_brute_force(spark, strategy):
    idx, q, items, qs = _data(spark)
    res = vector_topk(idx, q, 5, strategy=strategy, grid_query_rows=7, grid_item_rows=50).collect()
    got = {}
    for r in sorted(res, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.source_path, r.chunk_index))
        assert r.content == f"c{r.chunk_index}"
    assert got == _brute(items, qs, 5)


def test_per_query_limit(spark):
    idx, q, items, qs = _data(spark)
    from pyspark.sql import functions as F
    ql = q.withColumn("lim", (F.col("query_id") % 3 + 1).cast("int"))
    res = vector_topk(idx, ql, 3, limit_col="lim").collect()
    counts = {}
    for r in res:
        counts[r.query_id] = counts.get(r.query_id, 0) + 1
    assert all(counts[j] == j % 3 + 1 for j in counts)


def test_dimension_mismatch_raises(spark):
    idx, q, _, _ = _data(spark, dim=8)
    bad = spark.createDataFrame([(0, [1.0, 2.0])], "query_id long, embedding array<float>")
    with pytest.raises(Exception, match="dimension"):
        vector_topk(idx, bad, 2, payload_cols=()).collect()


def test_grid_blocks_meet_in_any_number_of_partitions(spark):
    """Both sides of a block pair are dealt to the same task, also where tasks are not merged."""
    idx, q, items, qs = _data(spark)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "29"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        res = vector_topk(idx, q, 3, strategy="grid", grid_query_rows=7, grid_item_rows=50).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {}
    for r in sorted(res, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.source_path, r.chunk_index))
    assert got == _brute(items, qs, 3)


def test_single_precision_only_where_it_is_exact():
    rng = np.random.default_rng(2)
    for x, kind in ((rng.integers(0, 40, (50, 384)), np.float32), (rng.integers(0, 4000, (50, 384)), np.float64), (rng.normal(size=(50, 384)), np.float64)):
        x = x.astype(np.float32)
        reach = vector_search._single_reach(x, vector_search._norms(x))
        s = vector_search._dots(x, x, reach, reach)
        assert s.dtype == kind and np.array_equal(s, x.astype(float) @ x.astype(float).T)


@pytest.mark.parametrize("strategy", ["broadcast", "grid"])
def test_ties_are_cut_by_key(spark, strategy):
    """Thousands of equal vectors: the first keys win in either plan."""
    idx = spark.createDataFrame([(f"p{i % 9}", i, "c", [1.0, 2.0]) for i in range(3000)], "source_path string, chunk_index int, content string, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(j, [2.0, float(j)]) for j in range(4)], "query_id long, embedding array<float>")
    got = vector_topk(idx, q, 6, strategy=strategy, grid_query_rows=2, grid_item_rows=500).collect()
    want = sorted((f"p{i % 9}", i) for i in range(3000))[:6]
    assert sorted((r.query_id, r["rank"], r.source_path, r.chunk_index) for r in got) == [(j, n + 1, *w) for j in range(4) for n, w in enumerate(want)]


def test_lsh_recall(spark):
    """Of the whole embedding table's true top 5 at least 0.9 are found."""
    from quarry.plans.q_retrieval import q_lsh_recall
    assert q_lsh_recall(spark, "/root/testdata/sf0.01").first().recall >= 0.9


def test_lsh_blocks_of_a_bucket(spark, monkeypatch):
    """Buckets cut into small blocks give the result of whole ones."""
    from quarry.operators import vector_search as vs
    idx, q, _, _ = _data(spark)
    want = sorted(map(tuple, vs.vector_topk_lsh(idx, q, 4, bands=3, bits=2).collect()))
    monkeypatch.setattr(vs, "LSH_ROWS", 5)
    assert sorted(map(tuple, vs.vector_topk_lsh(idx, q, 4, bands=3, bits=2).collect())) == want and want


def test_lsh_sends_a_vector_once_a_block(spark, monkeypatch):
    """Not once for each of its buckets: 300 items and 40 queries in blocks of 200 rows; and as many found as by signatures."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps
    idx, q, items, qs = _data(spark)
    sent, apply = [], PandasCogroupedOps.applyInArrow
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", lambda self, *a: (sent.append((self._gd1._df.count(), self._gd2._df.count())), apply(self, *a))[1])
    monkeypatch.setattr(vector_search, "LSH_BYTES", 200 * 4 * 16)
    got = {(r.query_id, r["rank"]): r.chunk_index for r in vector_search.vector_topk_lsh(idx, q, 4, bands=4, bits=3, probes=2).collect()}
    assert sent == [(80, 300)]
    qs_, ix_ = (vector_search.lsh_signatures(d, [c], "embedding", 16, 4, 3, probes=p) for d, c, p in ((q, "query_id", 2), (idx, "chunk_index", 1)))
    pairs = {(r.query_id, r.chunk_index) for r in qs_.join(ix_, ["band", "sig"]).select("query_id", "chunk_index").distinct().collect()}
    for j in range(40):
        order = sorted(((-(qs[j] @ items[i]) / np.linalg.norm(items[i]), f"p{i % 7}", i) for i in range(300) if (j, i) in pairs and i != 9))[:4]
        assert [got.get((j, n)) for n in range(1, len(order) + 1)] == [o[2] for o in order]


def test_candidates_of_a_query_do_not_grow_with_the_blocks(monkeypatch):
    monkeypatch.setattr(vector_search, "SCORE_CELLS", 64)
    r = np.random.default_rng(3)
    q, x, place = r.integers(0, 3, (10, 6)) + 0.0, r.integers(0, 3, (300, 6)) + 0.0, r.permutation(300)
    qi, ri, sims = vector_search._block_candidates(q, vector_search._norms(q), x, vector_search._norms(x), place, 3)
    assert np.array_equal(qi, np.repeat(np.arange(10), 3))
    with np.errstate(all="ignore"):
        full = (q @ x.T) / (vector_search._norms(q)[:, None] * vector_search._norms(x)[None])
    for i in range(10):
        want = sorted((-s, p) for s, p in zip(full[i], place, strict=True) if np.isfinite(s))[:3]
        assert [(-s, place[j]) for s, j in zip(sims[qi == i], ri[qi == i], strict=True)] == want


def test_single_precision_decides_nothing(monkeypatch):
    """Scores closer than single precision can tell, ties and rows without a direction: the order is that of double."""
    r = np.random.default_rng(8)
    base = r.normal(size=64)
    x = base + r.normal(size=(600, 64)) * 1e-7
    x[7], x[9], x[11], x[13] = x[3], 0, np.nan, np.inf
    q, place = np.stack([base, r.normal(size=64), np.zeros(64), x[3]]), r.permutation(600)
    monkeypatch.setattr(vector_search, "SCORE_CELLS", 1 << 17)
    got = vector_search._block_candidates(q, vector_search._norms(q), x, vector_search._norms(x), place, 6, np.array([-np.inf, -1, 0, 0.5]))
    with np.errstate(all="ignore"):
        full = np.array([[np.einsum("i,i->", a, b) for b in x] for a in q]) / (vector_search._norms(q)[:, None] * vector_search._norms(x)[None])
    for i, low in enumerate([-np.inf, -1, 0, 0.5]):
        want = sorted((-s, p) for s, p in zip(full[i], place, strict=True) if np.isfinite(s) and s >= low)[:6]
        mine = got[0] == i
        assert np.allclose(-got[2][mine], [w[0] for w in want], rtol=0, atol=1e-15) and len(want) == (0 if i == 2 else 6)
    assert vector_search._unit_single(x, vector_search._norms(x)).dtype == np.float32


def test_buckets_of_a_batch_are_counted_in_slices(monkeypatch):
    widest, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, minlength=0: widest.append(minlength) or count(x, minlength=minlength))
    rows = [[i % 8, (i * 3) % 8, 2] if i % 5 else None for i in range(2000)]
    got = embedding._bincount_udf(8).func(pa.array(rows, pa.list_(pa.int32()))).to_pylist()
    assert got == [None if r is None else [float(r.count(b)) for b in range(8)] for r in rows]
    assert max(widest) <= 512 * 8
