"""Lexical search: tokens, stemming, query syntax, match and cover density against brute force."""

import numpy as np
from conftest import SF_SMALL
from pyspark.sql import functions as F

import brute
from quarry.functions.text import s_stem
from quarry.operators.lexical import lexical_match, lexical_topk, postings, query_terms
from quarry.plans import fixtures as fx


def test_stemmer(spark):
    words = ["queries", "ties", "flies", "aies", "eies", "horses", "does", "toes", "cats", "bus", "glass", "is", "gas"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r.s for r in df.select(s_stem(F.col("w")).alias("s")).collect()]
    assert got == [brute.stem(w) for w in words]
    assert got[:3] == ["query", "ty", "fly"]


def _compare(spark, chunks, queries):
    idx = spark.createDataFrame(chunks, "source_path string, chunk_index int, content string")
    qs = spark.createDataFrame(queries, "query_id long, query string")
    post, terms = postings(idx), query_terms(qs)
    got = {(r.query_id, r.source_path, r.chunk_index): r.lexical_score
           for r in lexical_topk(post, terms, len(chunks), chunks=idx).collect()}
    m = lexical_match(post, terms, chunks=idx)
    assert {(r.query_id, r.source_path, r.chunk_index) for r in m.collect()} == set(got)
    exp = {}
    for qid, q in queries:
        for sp, ci, text in chunks:
            if brute.matches(q, text):
                exp[(qid, sp, ci)] = float(np.float32(brute.cover_density(q, text)))
    assert set(got) == set(exp)
    for k in exp:
        assert abs(got[k] - exp[k]) < 1e-9, k


def test_query_syntax_hand_cases(spark):
    chunks = [("a", 0, "The fat rats ate the cheese"), ("a", 1, "fat cats and rats"),
              ("a", 2, "supernovae stars shine"), ("a", 3, "stars of supernovae"),
              ("b", 0, "signal segmentation fault"), ("b", 1, "signal only here"),
              ("b", 2, "the the the"), ("b", 3, "rats rats fat rats")]
    queries = [(1, "fat rats"), (2, '"supernovae stars" -crab'), (3, 'signal -"segmentation fault"'),
               (4, "cats or stars"), (5, "the of"), (6, '"fat rats"'), (7, "rat"), (8, "or fat"),
               (9, '"sad cat" or "fat rat"'), (10, "-fat"), (11, 'cats or -"fat rats"'), (12, "-rats -signal"),
               (13, "-the"), (14, "-zebra")]
    _compare(spark, chunks, queries)


def test_corpus_with_query_variants(spark):
    idx = fx.line_index(spark, SF_SMALL)
    chunks = [(r.source_path, r.chunk_index, r.content) for r in idx.collect()]
    qs = [(r.query_id, r.query) for r in fx.search_queries(spark, SF_SMALL).collect()][:10]
    variants = []
    for qid, q in qs:
        variants += [(qid * 10, q), (qid * 10 + 1, '"' + q + '"'), (qid * 10 + 2, q.replace(" ", " or ", 3))]
    _compare(spark, chunks, variants)


def test_long_item_needs_every_token(spark):
    from quarry.operators.lexical import query_terms
    words = "-".join(f"w{i}x" for i in range(1005))
    rows = query_terms(spark.createDataFrame([(1, f"{words} last")], "query_id int, query string")).collect()
    assert len({r.item_id for r in rows}) == 1006
