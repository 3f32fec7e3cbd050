"""One scan of the chunks: same matches, scores and lists as the joins, in plans without a shuffle of postings."""

import random

import numpy as np
import pyarrow as pa

import brute
from quarry.operators import blockmax, chunk_scan, embedding, lexical, vector_search

CHUNK = "source_path string, chunk_index int, content string"
QUERIES = ["fat rats", '"fat rats"', "rats -cheese", "cats or fat stars", "-fat", '-"fat rats" or cats', "of the", "queries", "nowhere fat",
           '"rats ate the cheese"', "glass classes or ties"]


def _chunks(n: int = 300):
    r = random.Random(4)
    words = "the fat rat rats ate cheese cats star stars of query queries glass class classes tie ties".split()
    rows = [(f"d{i // 4:03d}", i % 4, " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for i in range(n)]
    return rows + [("empty", 0, None)]


def _rows(df, *cols):
    return sorted((tuple(x[c] if not isinstance(x[c], float) else round(x[c], 6) for c in cols) for x in df.collect()), key=str)


def test_scan_equals_brute_force(spark, monkeypatch):
    rows = _chunks()
    chunks = spark.createDataFrame(rows, CHUNK)
    terms, n = lexical.prepared_terms(spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string"))
    found = lexical.lexical_match(lexical.build_postings(chunks), terms, term_rows=n, chunks=chunks, scored=True)
    got = {(x.query_id, x.source_path, x.chunk_index): x.lexical_score or 0.0 for x in found.collect()}
    expected = {(i, p, c): float(np.float32(brute.cover_density(q, t or ""))) for i, q in enumerate(QUERIES) for p, c, t in rows if brute.matches(q, t or "")}
    assert set(got) == set(expected) and all(abs(got[k] - expected[k]) < 1e-9 for k in expected)
    top = lexical.lexical_topk(lexical.build_postings(chunks), terms, 5, term_rows=n, chunks=chunks)
    want = []
    for i in range(len(QUERIES)):
        best = sorted((-s, p, c) for (q, p, c), s in expected.items() if q == i)[:5]
        want += [(i, r, p, c, round(-s, 6)) for r, (s, p, c) in enumerate(best, 1)]
    assert _rows(top, "query_id", "lexical_rank", "source_path", "chunk_index", "lexical_score") == sorted(want, key=str)


def test_repeated_and_null_keys_equal_the_joins(spark):
    rows = _chunks(40) + _chunks(8) + [("d001", 0, "fat cats"), (None, 1, "fat rats"), (None, 1, "cats"), ("x", None, "queries")]
    chunks = spark.createDataFrame(rows, CHUNK)
    q = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")
    terms, n = lexical.prepared_terms(q)
    cols = ("query_id", "lexical_rank", "source_path", "chunk_index", "lexical_score")
    plain = _rows(lexical.lexical_topk(lexical.postings(chunks), terms, 6, term_rows=n, chunks=chunks), *cols)
    assert _rows(lexical.lexical_topk(lexical.build_postings(chunks), terms, 6, term_rows=n, chunks=chunks), *cols) == plain
    top, _ = blockmax.lexical_topk_blocks(blockmax.build_block_index(chunks, block_chunks=8), q, 6)
    assert _rows(top, *cols) == plain


def test_match_and_score_shuffle_no_postings(spark):
    chunks = spark.createDataFrame(_chunks(20), CHUNK)
    terms, n = lexical.prepared_terms(spark.createDataFrame([(1, "fat rats")], "query_id long, query string"))
    post = lexical.build_postings(chunks)
    plan = lexical.cover_density(post, terms, lexical.lexical_match(post, terms, term_rows=n, scored=True), term_rows=n)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "InMemory" not in plan and "explode" not in plan


def test_units_are_bounded_and_least_is_carried(monkeypatch):
    monkeypatch.setattr(chunk_scan, "UNIT_TOKENS", 50)
    tokens = [["a"] * (i % 7) + ["b"] for i in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array([f"k{i:03d}" for i in range(100)]), pa.array(tokens)], ["key", "tokens"])
    q = chunk_scan.Queries(["a", "b"], np.array([0, 1], np.int32), 2, [(((((0, 0),),), ()),)])
    units = list(chunk_scan._units(iter([batch]), q, ["key"], None))
    assert len(units) > 5 and sum(t.num_rows for _, t in units) == 100
    assert sum(len(u.places(0)) for u, _ in units) == sum(i % 7 for i in range(100))
    rows, scores, possible, read = units[0][0].first(q.shapes[0], 3, 100.0, True)
    assert possible == 1 and read == 0 and not len(rows)


def test_vectors_are_made_once_a_scoring_pass(spark):
    index = embedding.embed_hashing(spark.createDataFrame(_chunks(30), CHUNK), "content")
    q = embedding.embed_hashing(spark.createDataFrame([(1, "fat rats")], "query_id long, query string"), "query")
    schema = vector_search._output_schema(index, q, "query_id", ["source_path", "chunk_index"])
    found = vector_search._broadcast_candidates(index, q, 3, ["source_path", "chunk_index"], "embedding", "query_id", "embedding", schema)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = [r.embedding for r in index.orderBy("source_path", "chunk_index").select("embedding").collect()]
    texts = [r[2] for r in sorted(_chunks(30), key=lambda r: r[:2])]
    for v, t in zip(got, texts, strict=True):
        assert (v is None) == (t is None)
        if t is not None:
            counts = np.zeros(embedding.DEFAULT_DIM)
            for w in brute.tokens(t):
                counts[embedding.hash_bucket(w, embedding.DEFAULT_DIM)] += 1
            assert list(counts) == v


def test_grid_copies_grow_slower_than_its_rows(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "GRID_ROWS", 64)
    monkeypatch.setattr(vector_search, "GRID_CELLS", 1)
    rng = np.random.default_rng(1)
    v = rng.integers(0, 4, (200, 6)).astype(float)
    idx = spark.createDataFrame([(f"p{i:03d}", i, [float(x) for x in r]) for i, r in enumerate(v)], "source_path string, chunk_index int, embedding array<float>")
    q = idx.selectExpr("chunk_index AS query_id", "embedding")
    both = [_rows(vector_search.vector_topk(idx, q, 2, payload_cols=(), strategy=s), "query_id", "rank", "chunk_index", "similarity") for s in ("grid", "broadcast")]
    assert both[0] == both[1]
