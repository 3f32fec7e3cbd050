"""Token files, packing and mixing."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import mixing, packing, token_files, tokens

from .conftest import rows_of

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expect(library, rows):
    return [(r.doc_id, np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], np.uint32)) for r in rows]


def test_ids_are_the_librarys(library, docs, monkeypatch):
    texts = [r.text for r in docs.collect()] + ["x's 'tis it's we'll '' 12a3 ... …! a…!b ẖ H̱ a\x1cb _a_ '!s éÅ 1², ½a ﬁ ́a ≠ !́", "A" * 3000, "word wide \x0b tab\x0cs"]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [i.tolist() for i in tokens.WordTokenizer(PATH).encode(pa.array(texts))] == want
    monkeypatch.setattr(tokens, "CHUNK", 200)  # long texts in runs, and a memory that overflows
    monkeypatch.setattr(tokens, "MEMO", 300)
    assert [i.tolist() for i in tokens.WordTokenizer(PATH).encode(pa.array(texts))] == want
    assert list(tokens.WordTokenizer(PATH).encode(pa.array([], pa.string()))) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aB'., \n!1é́Σ<|>"), st.characters(exclude_categories=("Cs",))), max_size=40), max_size=6))
def test_ids_property(texts):
    t, lib = tokens.tokenizer(PATH), Tokenizer.from_file(PATH) if not hasattr(test_ids_property, "lib") else test_ids_property.lib
    test_ids_property.lib = lib
    assert [i.tolist() for i in t.encode(pa.array(texts, pa.string()))] == [lib.encode(x, add_special_tokens=False).ids for x in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=200), st.integers(1, 30))
def test_simple8b_round_trip(values, repeat):
    v = np.array(values * repeat, np.uint64)
    words, offsets = token_files.simple8b_encode(v)
    assert np.array_equal(token_files.simple8b_decode(words, offsets, len(v)), v)
    assert len(offsets) == -(-len(v) // token_files.BLOCK)


def test_token_files(spark, docs, clashing, none, library, tmp_path, monkeypatch):
    want = expect(library, docs.collect())
    path = str(tmp_path / "t")
    token_files.write_token_files(clashing, path, PATH)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in want), key=lambda i: (i is not None, i or 0))
    assert sorted((repr(r.doc_id), tuple(r.ids)) for r in got) == sorted((repr(i), tuple(x.tolist())) for i, x in want)
    start = 0
    for r in got:
        ids = np.array(r.ids, np.uint32)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    token_files.write_token_files(none, str(tmp_path / "e"), PATH)
    assert token_files.read_token_files(spark, str(tmp_path / "e"), ids=False).count() == 0


def test_packing(docs, clashing, none, library):
    want = expect(library, docs.collect())
    for source, window, unit in ((clashing, 4096, 64), (docs, 64, 8)):
        got = packing.pack_documents(source, PATH, window=window, unit=unit, ids=True).collect()
        sequences, pieces = defaultdict(list), defaultdict(list)
        for r in got:
            assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, np.uint32).tobytes())
            sequences[r.sequence_id].append((r.offset, r.length))
            pieces[r.doc_id].append((r.start, r.ids, r.doc_tokens))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= window
        tokens_ = sum(len(x) for _, x in want)
        assert len(sequences) <= -(-tokens_ // window) + 2  # hardly any padding
        for i in {i for i, _ in want}:
            docs_ = sorted(x.tolist() for k, x in want if k == i)
            parts = sorted(pieces[i], key=lambda p: p[0])
            if len(docs_) == 1:
                assert sum((p[1] for p in parts), []) == docs_[0] and {p[2] for p in parts} == {len(docs_[0])}
            assert sum(len(p[1]) for p in parts) == sum(map(len, docs_))
    assert packing.pack_documents(none, PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 3000), max_size=20))
def test_plan_uses_each_piece_once(histogram):
    histogram = {k if k < 8 else k // 8 * 8: v for k, v in histogram.items()}
    patterns = packing.plan(histogram, 64, 8)
    used = defaultdict(int)
    for times, need in patterns:
        assert times > 0 and sum(k * n for k, n in need.items()) <= 64
        for k, n in need.items():
            used[k] += times * n
    assert used == histogram
    places = set()
    for k, rows in packing.slots(patterns).items():
        for rank in range(histogram[k]):
            row = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
            nth = rank - row[0]
            at = (row[1] + nth // row[2], row[3] + nth % row[2] * k)
            assert not places & {(at[0], at[1] + j) for j in range(k)}
            places |= {(at[0], at[1] + j) for j in range(k)}


def test_nnls():
    rng = np.random.default_rng(0)
    a, x = rng.random((12, 30)), np.maximum(rng.normal(size=30), 0)
    got = packing.nnls(a, a @ x)
    assert (got >= 0).all() and np.allclose(a @ got, a @ x, atol=1e-6)
    far = packing.nnls(np.eye(3), np.array([1.0, -2, 3]))
    assert np.allclose(far, [1, 0, 3])


def mix_brute(rows, weights=(5, 2, 1), share=1.5):
    import hashlib
    size = [len((r.text or "").split()) if not (r.text or "").strip("\x1c\x1d\x1e\x1f\x85\xa0") == "?" else 0 for r in rows]
    total = defaultdict(int)
    for r, n in zip(rows, size):
        total[r.source] += n
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, budget = {}, set(names), share * sum(total.values())
    while open_:  # share out, stop those above twice their source, share again
        left = budget - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * total[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in over}
        open_ -= over
    copies = []
    for k, s in enumerate(names):
        run = 0
        own = sorted((hashlib.md5(f"mix|{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest(), n, i) for i, (r, n) in enumerate(zip(rows, size)) if r.source == s)
        for epoch in (0, 1):
            for key, n, i in own:
                run += n
                if target[s]:
                    copies.append((run / target[s], epoch, k, key, n, i))
    left, taken = int(budget), [0] * len(rows)
    for *_, n, i in sorted(copies):
        take = min(n, left)
        taken[i] += take
        left -= take
    return [(r.doc_id, n, total[r.source], round(target[r.source], 6), t) for r, n, t in zip(rows, size, taken)], target


@pytest.mark.parametrize("ranges", [50_000, 7])
def test_mixing(docs, clashing, ranges):
    got = mixing.mix_sources(clashing if ranges == 7 else docs, range_rows=ranges)
    want, target = mix_brute(docs.collect())
    have = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got.collect()]
    key = lambda r: (repr(r[0]), r[1], r[4])
    assert sorted(have, key=key) == sorted(want, key=key)
    assert all(0 <= r[4] <= 2 * r[1] for r in have)


def test_mixed_rows(clashing, none):
    out = mixing.mixed(clashing)
    assert out.columns == clashing.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += 1
    want = defaultdict(int)
    for r in mixing.mix_sources(clashing).collect():
        want[r.doc_id] += r.copies
    assert got == {k: v for k, v in want.items() if v}
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed(none).count() == 0
    assert rows_of(mixing.mix_sources(clashing), "doc_id", "taken") == rows_of(mixing.mix_sources(clashing.repartition(3)), "doc_id", "taken")
