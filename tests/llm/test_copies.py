"""Exact, near and passage copies against brute force."""

import hashlib
import itertools
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, simhash, suffix_array, suffix_dedup

from .conftest import prose, rows_of

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact_brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r.text or "").translate(ASCII_LOWER)].append(r.doc_id)
    out = []
    for norm, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, hashlib.sha256(norm.encode()).hexdigest()))
            first = first and i != keep
    return sorted(out, key=repr)


COLS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, clashing, weak):
    # A digest of a few values makes every decision fall to the full texts.
    kw = {"digest": lambda c: F.unhex(F.hex(F.crc32(c) % 7))} if weak else {}
    assert rows_of(exact_dedup.exact_dedup(clashing if weak else docs, **kw), *COLS) == exact_brute(docs.collect())


def test_exact_dedup_small_batches(docs, spark, tmp_path):
    """State carries over from one micro-batch to the next."""
    path = str(tmp_path / "d")
    (docs.select(F.col("doc_id").alias("id"), exact_dedup.sha256(exact_dedup.lower_ascii(F.col("text"))).alias("digest"),
                 F.monotonically_increasing_id().alias("row"), F.lit("f").alias("file"), F.lit(1).cast("bigint").alias("n_bytes"))
     .repartition(4).write.parquet(path))
    state = exact_dedup.dedup_state(path, spark, batch_bytes="1")
    want = {(r[4], r[2]) for r in exact_brute(docs.collect())}
    assert {(r.digest.hex(), r.group_size) for r in state.collect()} == want


def test_exact_dedup_rows(clashing, none):
    left = exact_dedup.deduplicated(clashing)
    assert left.columns == clashing.columns
    assert sorted(map(repr, (r.doc_id for r in left.collect()))) == sorted(repr(r[0]) for r in exact_brute(clashing.collect()) if r[3])
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.deduplicated(none).count() == 0


def fingerprint_brute(text, width=3):
    words = (text or "").translate(ASCII_LOWER).encode().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + width]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def components_brute(fps, bits):
    todo, label = set(fps), {}
    while todo:
        group, front = set(), [todo.pop()]
        while front:
            a = front.pop()
            group.add(a)
            near = {b for b in todo if (a ^ b).bit_count() <= bits}
            todo -= near
            front += near
        for a in group:
            label[a] = frozenset(group)
    return label


def near_brute(rows, bits=3):
    fp = [fingerprint_brute(r.text) for r in rows]
    label, least = components_brute(fp, bits), {}
    for r, f in zip(rows, fp):
        if r.doc_id is not None:
            least[label[f]] = min(r.doc_id, least.get(label[f], r.doc_id))
    return sorted(((r.doc_id, f"{f:016x}", least.get(label[f])) for r, f in zip(rows, fp)), key=repr)


def test_simhash(docs, clashing, none):
    for d in (docs, clashing):
        got = simhash.near_duplicates(d).select("doc_id", simhash.hex_fingerprint("fp").alias("h"), "component_id")
        assert rows_of(got, "doc_id", "h", "component_id") == near_brute(docs.collect())
    assert simhash.near_duplicates(none).count() == 0


def test_one_of_each(clashing, none):
    left = simhash.one_of_each(clashing)
    assert left.columns == clashing.columns
    assert sorted(repr(r.doc_id) for r in left.collect()) == sorted({repr(c) for _, _, c in near_brute(clashing.collect())})
    assert simhash.one_of_each(none).count() == 0


def test_one_of_each_without_ids(spark):
    """Unrelated texts stay, also if all their ids are null or the same."""
    texts = [prose(f"odd{i}", 60) for i in range(8)]
    rows = [(None, t) for t in texts[:5]] + [(None, texts[0].upper()), (7, texts[5]), (7, texts[6]), (7, texts[7]), (8, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = rows_of(simhash.one_of_each(docs), "doc_id", "text")
    assert len(left) == 8 and {(i, t.lower()) for i, t in left} == {(None, t) for t in texts[:5]} | {(7, t) for t in texts[5:]}


@pytest.mark.parametrize(("bits", "hot", "cell"), [(3, 2048, 16384), (3, 4, 50), (0, 2, 50), (5, 10, 200)])
def test_fingerprint_links(spark, bits, hot, cell):
    """Random clusters, chains and crowded blocks: the same components as all pairs."""
    rng = np.random.default_rng(bits)
    seeds = rng.integers(0, 2**63, 12, dtype=np.uint64)
    codes = {0, 2**64 - 1}
    for s in seeds:
        for _ in range(25):
            s ^= np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)))
            codes.add(int(s))
    base = int(seeds[0]) >> 48 << 48  # one block value that many share
    codes |= {base | int(x) for x in rng.integers(0, 2**48, 150)}
    df = spark.createDataFrame([(int(np.uint64(c).view(np.int64)),) for c in codes], "fp bigint")
    from quarry.llm.components import connected_components
    links = simhash.fingerprint_links(df, bits, cell=cell, hot=hot)
    unsigned = lambda x: int(np.int64(x).view(np.uint64))
    got = defaultdict(set)
    for r in connected_components(links).collect():
        got[r.label].add(unsigned(r.node))
    want = {g for g in components_brute(codes, bits).values() if len(g) > 1}
    assert {frozenset(g) for g in got.values()} == want


def test_components(spark):
    from quarry.llm.components import connected_components
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (100, 102), (7, 7), (None, 3)]
    got = connected_components(spark.createDataFrame(chain, "a bigint, b bigint"))
    assert rows_of(got, "node", "label") == sorted([(i, 0) for i in range(61)] + [(i, 100) for i in (100, 101, 102)], key=repr)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(3)
    for alphabet in (b"ab", b"a", bytes(range(254))):
        strings = [bytes(rng.choice(list(alphabet), rng.integers(1, 90)).astype(np.uint8)) for _ in range(30)]
        text, _ = suffix_array.lay_out(strings)
        raw = text.tobytes()
        order = suffix_array.suffix_order(text, 50)
        key = lambda i: raw[i:raw.index(0, i)][:50]  # noqa: B023, E731
        places = [i for i in range(len(raw)) if raw[i]]
        assert sorted(order.tolist()) == places
        assert [key(i) for i in order] == sorted(map(key, places))
        for a, b, n in itertools.islice(zip(order, order[1:], suffix_array.adjacent_prefixes(text, order, 50)[1:]), 500):
            x, y = raw[a:a + 50], raw[b:b + 50]
            assert n == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


def repeats_brute(rows, n=50):
    least, out = {}, []
    key = lambda i: (i is None, i or 0)
    for r in rows:
        t = (r.text or "").encode()
        for p in range(len(t) - n + 1):
            s = t[p:p + n]
            least[s] = min(least.get(s, key(r.doc_id)), key(r.doc_id))
    for r in rows:
        t = (r.text or "").encode()
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - n + 1):
            if least[t[p:p + n]] < key(r.doc_id):
                gone[p:p + n] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((r.doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("hot", "bucket"), [(suffix_dedup.HOT, suffix_dedup.BUCKET), (2, 1 << 14)])
def test_suffix_dedup(docs, clashing, hot, bucket):
    got = suffix_dedup.remove_repeats(clashing if hot == 2 else docs, hot=hot, bucket_bytes=bucket, kept_text=True)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeats_brute(docs.collect())
    for r in got.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and hashlib.sha256(r.kept_text).hexdigest() == r.kept_sha256


def test_suffix_dedup_empty(none):
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_buckets_are_even():
    """Anchors have the least hashes of their windows, yet no bucket holds much more than its share."""
    texts = [prose(f"even{i}", 2000).encode() for i in range(60)]
    block = suffix_dedup.Block(np.arange(60), np.array([len(t) for t in texts]), b"".join(texts))
    _, number, bucket = block.distinct(6)
    size = np.bincount(bucket[number], block.count, 64)
    assert size.max() < 2 * size.mean()
    assert np.all(np.diff(bucket) >= 0)


def test_blocks_send_buckets_few_cheap_rows(monkeypatch):
    """No bucket count above the nearest power of two, and no codec made for each array that a bucket gets."""
    assert [suffix_dedup.bucket_bits(n << 20, 8 << 20) for n in (0, 8, 9, 11, 12, 840, 10_000)] == [0, 0, 0, 0, 1, 7, 10]
    made = []
    for name in ("ZstdCompressor", "ZstdDecompressor"):
        kind = getattr(suffix_dedup.zstandard, name)
        monkeypatch.setattr(suffix_dedup.zstandard, name, lambda *a, kind=kind, **k: (made.append(kind), kind(*a, **k))[1])
    for i in range(50):
        a = np.arange(i, dtype=np.uint16)
        assert np.array_equal(suffix_dedup._unzip(suffix_dedup._zip(a), np.uint16), a)
    assert len(made) <= 2
