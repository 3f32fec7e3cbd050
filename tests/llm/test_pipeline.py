"""The pipeline against a plain version of its stages, and its edge cases."""

from collections import Counter, defaultdict

import corpus_pipeline
from quarry.llm import langid
from quarry.sources.tables import table

from .test_copies import exact_brute, near_brute
from .test_tokens import mix_brute

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    named = {r.doc_id for r in langid.identify(docs).where("lang_pred <> 'und'").collect()}
    rows = [r for r in docs.collect() if r.doc_id in named]
    kept = {r[0] for r in exact_brute(rows) if r[3]}
    rows = [r for r in rows if r.doc_id in kept]
    one = {c for _, _, c in near_brute(rows)}
    rows = [r for r in rows if r.doc_id in one]
    taken = {i: (n, t) for i, n, _, _, t in mix_brute(rows)[0]}
    copies = Counter({i: t // n for i, (n, t) in taken.items() if n and t // n})
    got = defaultdict(list)
    out = corpus_pipeline.run(spark, SF).collect()
    for r in out:
        got[r.doc_id].append(r)
    assert got.keys() == copies.keys()
    for i, parts in got.items():
        assert sum(p.length for p in parts) == copies[i] * parts[0].doc_tokens
    used = defaultdict(int)
    for r in out:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096 and sum(4096 - n for n in used.values()) < 2 * 4096


def test_stages_on_odd_rows(spark, docs, clashing, none):
    assert len(corpus_pipeline.STAGES) == 5
    for d in (none, clashing):
        at = d
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, SF)
            if k < 4:
                assert out.columns == d.columns
                at = out.cache()
            n = out.count()
        assert (n == 0) == (d is none)
