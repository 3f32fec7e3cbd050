"""Language and quality models, nearest neighbours and license scans."""

import itertools
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import graph_ann, langid, license_scan, line_crf
from quarry.sources.tables import table

from .conftest import prose, rows_of

SF = "/root/testdata/sf0.01"
ROOT = Path(__file__).resolve().parents[2]


def rest(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def test_language_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    rows = langid.identify(docs, keep=("doc_id", "lang")).collect()
    assert len(rows) == docs.count() and all(r.held_out == (rest(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang == r.lang_pred for r in rows if r.held_out and r.lang]
    assert sum(held) / len(held) > 0.97


def test_language_edges(docs, clashing, none):
    for d in (docs, clashing):
        got = langid.identify(d)
        assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == docs.count()
        by_id = {r.doc_id: r for r in got.collect()}
        for i in (500, 501, 502, 503, 506):
            assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0)
        assert by_id[None].held_out
        assert sum(by_id[i].lang_pred == "de" for i in range(400, 430)) >= 29 and by_id[505].lang_pred == "en"
    left = langid.accepted(clashing)
    assert left.columns == clashing.columns
    assert {500, 501, 502, 503, 506}.isdisjoint({r.doc_id for r in left.select("doc_id").collect()}) and left.count() >= docs.count() - 9
    assert langid.identify(none).count() == 0 and langid.accepted(none).count() == 0


def test_prediction_ignores_labels(spark, docs):
    """Other lang, source and doc_id on held-out rows change nothing."""
    out = langid.held_out(1, 3)
    changed = docs.withColumn("lang", F.when(out, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    a, b = (rows_of(langid.identify(d), "doc_id", "lang_pred", "score") for d in (docs, changed))
    assert a == b


def test_sample_of_any_size(spark):
    """A language of thousands of millions of documents still has a sample, and one id on all rows a bounded one."""
    rows = spark.createDataFrame([(i if i % 2 else 7, prose(i, 12), "en" if i % 3 else "de") for i in range(3000)] + [(7, "same", "en")] * 2000, "doc_id bigint, text string, lang string")
    n = {r["lang"]: r["n"] for r in langid.sampled(rows, {"en": 4000, "de": 1000}, "lang", 100).groupBy("lang").agg(F.count("key").alias("n")).collect()}
    assert all(20 < n[k] <= 200 for k in ("en", "de"))
    every = langid.sampled(rows, {"en": 1, "de": 1}, "lang", 100)
    assert {r["lang"]: r["n"] for r in every.groupBy("lang").agg(F.count("key").alias("n")).collect()} == {"en": 200, "de": 200}
    assert every.where("text = 'same'").count() <= 1
    # 2e9 rows counted: the limit is a share of 2**63, not of a million.
    few = langid.sampled(rows.withColumn("doc_id", F.lit(None).cast("bigint")), {"en": 2_000_000_000, "de": 2_000_000_000}, "lang", 1_200_000)
    assert few.count() <= 12


def test_no_language(docs):
    got = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in got.collect()} == {("und", 0.0)}


def test_ftrl_is_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 600)
    x = [(np.array([k, 10 + int(rng.integers(0, 500))]), np.array([1.0, 0.5])) for k in y]
    w, b = langid.train_ftrl(x, y, 3, l1=0.5)
    assert (w == 0).mean() > 0.99 and all((w[k] + b).argmax() == k for k in range(3))
    logits = rng.normal(size=(4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    drawn = np.array([rng.choice(3, p=q) for q in p])
    assert abs(langid.fit_temperature(logits * 4, drawn) - 4) < 0.5


def test_quality_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = line_crf.quality(docs, labels)
    rows = got.join(labels, "doc_id", "left").collect()
    assert got.count() == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (rest(r.doc_id, 5) == 0) for r in rows)
    held = [(r.predicted, r.quality) for r in rows if r.held_out and r.quality is not None]
    assert np.mean([p == q for p, q in held]) > 0.9


def test_quality_edges(spark, docs, clashing, none):
    labels = spark.createDataFrame([(i, int(i < 20), 0) for i in range(40)] + [(None, 1, 0), (3, None, 0), (41, 7, 0)], "doc_id bigint, quality int, toxic int")
    for d in (docs, clashing):
        got = line_crf.quality(d, labels)
        assert got.count() == docs.count() and got.columns == ["doc_id", "held_out", "score", "predicted"]
        assert all(0 <= r.score <= 1 for r in got.collect())
    assert line_crf.quality(none, labels).count() == 0
    assert {r.score for r in line_crf.quality(docs, labels.limit(0)).collect()} == {0.5}
    flipped = labels.withColumn("quality", F.when(line_crf.held_out(0, 5), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows_of(line_crf.quality(docs, labels), "doc_id", "score") == rows_of(line_crf.quality(docs, flipped), "doc_id", "score")


def test_chain_marginals():
    rng = np.random.default_rng(0)
    lines = np.array([1, 6, 9, 2])
    unary, step = rng.normal(size=(18, 2)), rng.normal(size=(2, 2))
    one, pair, second = line_crf.marginals(unary, step, lines)
    at = 0
    for n in lines:
        want, both, total = np.zeros((n, 2)), np.zeros((n, 2, 2)), 0.0
        for s in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(unary[at + i, k] for i, k in enumerate(s)) + sum(step[a, b] for a, b in zip(s, s[1:])))
            total += w
            for i, k in enumerate(s):
                want[i, k] += w
                if i:
                    both[i, s[i - 1], k] += w
        assert np.allclose(want / total, one[at:at + n])
        for i in range(1, n):
            assert np.allclose(both[i] / total, pair[np.searchsorted(second, at + i)])
        at += n


def test_scores_of_long_texts(monkeypatch):
    """In runs of lines and pieces of lines, a text has the score that it has at once."""
    rng = np.random.default_rng(3)
    model = line_crf.LineCrf(rng.normal(0, 0.7, (3 * len(line_crf.NAMES), 2)), rng.normal(0, 1, (2, 2)))
    texts = ["\n".join(f"{prose(10 * k + i, 3 + 17 * (i % 4))}{'||' * (i % 3)}" + "\n" * (i % 5 == 4) for i in range(40)) for k in range(3)]
    texts += ["\n" * 500, "x" * 700 + " " + "ab! " * 300 + "y" * 999, "  " + "Ünter " * 400 + "\n" + "!!" * 600 + "\n", "same line here\n" * 60 + "中" * 400]
    want = model.scores(texts)
    for chunk, block in ((64, 7), (101, 1), (300, 64)):
        monkeypatch.setattr(line_crf, "CHUNK", chunk)
        monkeypatch.setattr(line_crf, "BLOCK", block)
        assert np.allclose(model.scores(texts), want, rtol=0, atol=1e-6)
        for t in texts:  # features of one long line, pieces against whole
            line = t.replace("\n", " ")
            got, whole = line_crf._long_line(line, 0, len(line)), line_crf._counted([line])
            assert all(np.array_equal(a, b) for a, b in zip(got, whole, strict=True))


@pytest.mark.parametrize("text", ['"some words of a line, and more of them\\n" * 600_000', '"no end of words " * 6_000_000', '"x" * 100_000_000'])
def test_score_memory(text):
    """Texts of 25 and 100 million characters take a small multiple of their size."""
    code = f"""
import resource
import numpy as np
from quarry.llm import line_crf as c
rng = np.random.default_rng(3)
model = c.LineCrf(rng.normal(0, 0.7, (3 * len(c.NAMES), 2)), rng.normal(0, 1, (2, 2)))
text = {text}
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert 0 <= model.scores([text])[0] <= 1
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT, check=True)
    assert int(out.stdout) < 700


def test_scores_do_not_depend_on_neighbours_in_the_batch():
    texts = [prose(i, 20) + "\n" + prose(-i, 9).upper() for i in range(12)] + ["", "\n\n"]
    crf = line_crf.train_crf(texts, np.arange(14) % 2, rounds=5)
    assert np.allclose(crf.scores(texts), [crf.scores([t])[0] for t in texts])


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)]
    rows += [(2000 + i, x[0].tolist(), 0) for i in range(400)]  # one hot vector
    rows += [(3000, None, 0), (3050, [0.0] * 16, 0), (3100, [float("nan")] + [1.0] * 15, 0), (3150, [float("inf")] + [1.0] * 15, 0),
             (3200, [None] + [1.0] * 15, 0), (None, x[1].tolist(), 0), (3250, [1.0, 2.0], 0), (3300, [2.0, 1.0], 0), (3350, [], 0), (3400, [1e300] * 16, 0)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")


def cosine_brute(vectors, divisor, k):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in vectors.collect() if r.vec_id is not None and r.embedding and None not in r.embedding]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    out = {}
    for i, v in rows:
        if i % divisor == 0:
            u = v / np.abs(v).max()
            s = [(-float(u @ (w / np.abs(w).max()) / (np.linalg.norm(u) * np.linalg.norm(w / np.abs(w).max()))), j) for j, w in rows if j != i and len(w) == len(v)]
            s = sorted((round(a, 9), j) for a, j in s)
            out[i] = s[:k]
    return out


def test_nearest(spark, vectors):
    want = cosine_brute(vectors, 50, 5)
    for d, shard in ((vectors, 4096), (vectors.withColumn("id", F.lit("x")).withColumn("score", F.lit(1)), 300)):
        got = {}
        for r in graph_ann.nearest(d, F.col("id") % 50 == 0, shard_rows=shard).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.rank, round(-r.score, 9), r.vec_id))
        assert got.keys() == {q for q, s in want.items() if s}
        assert all([r for r, _, _ in rows] == list(range(1, len(rows) + 1)) for rows in got.values())
        recall = [len({j for _, _, j in got[q]} & {j for _, j in s}) / len(s) for q, s in want.items() if s]
        assert np.mean(recall) >= 0.9
        assert [j for _, _, j in got[2000]] == [j for _, j in want[2000]]  # ties to the smaller ids
        scores = {q: dict((j, a) for a, j in s) for q, s in want.items()}
        assert all(abs(scores[q][j] - a) < 1e-7 for q, rows in got.items() for _, a, j in rows if j in scores[q])
    assert graph_ann.nearest(vectors.limit(0), F.col("id") % 50 == 0).count() == 0


def test_cosine_of_any_length():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(50, 7)), rng.normal(size=(50, 7))
    want = graph_ann.cosine(a, b)
    assert np.allclose(want, (a * b).sum(axis=1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1))
    for x, y in ((1e300, 1e-200), (1e-300, 1e308), (2.0 ** 500, 2.0 ** -900)):
        assert np.allclose(graph_ann.cosine(a / 9 * x, b / 9 * y), want, atol=1e-9)


def test_recall_on_the_embeddings(spark):
    e = table(spark, SF, "embeddings")
    want = cosine_brute(e, 50, 5)
    got = {}
    for r in graph_ann.nearest(e, F.col("id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {j for _, j in s}) / len(s) for q, s in want.items()]) >= 0.95


def test_license_scan(spark, docs, clashing, none):
    mit, gpl = license_scan.TEMPLATES["MIT"], license_scan.TEMPLATES["GPL-3.0-notice"]
    words = mit.split()
    rows = [(1, prose(1, 200) + " " + mit + " " + prose(2, 90)), (2, gpl.upper().replace(" ", "\n")), (3, " ".join(words[:60] + ["altered"] + words[60:])),
            (4, " ".join(words[:30])), (5, prose(3, 500)), (6, None), (7, ""), (8, "MIT License"), (9, gpl + " " + prose(4, 3000) + " " + mit), (9, "x " + gpl)]
    got = rows_of(license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")), "doc_id", "template")
    assert got == [(1, "MIT"), (2, "GPL-3.0-notice"), (3, "MIT"), (9, "GPL-3.0-notice"), (9, "GPL-3.0-notice"), (9, "MIT")]
    assert license_scan.scan_licenses(none).count() == 0
    own = {"t": " ".join(docs.where("doc_id = 3").first().text.split()[5:25])}
    for d in (docs, clashing):
        found = rows_of(license_scan.scan_licenses(d, own), "doc_id", "license", "containment")
        assert [f[0] for f in found] == [103, 3, None] and all(f[2] == 1 for f in found)
    with pytest.raises(ValueError, match="words"):
        license_scan.Templates({"short": "one two"})


def test_license_scan_against_all_windows(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    t = license_scan.Templates(license_scan.with_identifiers(license_scan.TEMPLATES))
    want = set()
    for r in rows:
        words = license_scan.words_of(r.text)
        every = license_scan.shingles_of(words)
        for name, need in t.shingles.items():
            if need & every and any(len(need & license_scan.shingles_of(words[p:p + 2 * len(need) + 4])) >= 0.8 * len(need) for p in range(len(words) - 4)):
                want.add((r.doc_id, name))
    got = set(rows_of(license_scan.scan_licenses(table(spark, SF, "documents")), "doc_id", "template"))
    assert got == want and got


def test_license_scan_at_every_place():
    """An altered copy is found wherever it begins; the brute force has a window at every word."""
    text = license_scan.TEMPLATES["GPL-3.0"]
    t = license_scan.Templates({"GPL-3.0": text})
    words, need = text.split(), t.shingles["GPL-3.0"]
    altered = " ".join(words[:20] + ["and", "so", "on", "with", "some", "words", "put", "in"] + words[20:])
    before = prose("before", 120).split()
    for at in range(len(need) + 2):
        whole = " ".join(before[:60 + at]) + " " + altered + " " + prose("after", 80)
        own = license_scan.words_of(whole)
        best = max(len(need & license_scan.shingles_of(own[p:p + 2 * len(need) + 4])) for p in range(len(own))) / len(need)
        assert best > 0.89
        assert [(n, s) for _, n, s, _, _ in license_scan.scan_texts([whole], t)] == [("GPL-3.0", best)]


def test_license_scan_of_long_texts(monkeypatch):
    """Cut into overlapping pieces, with words longer than a piece, the result is that of one piece."""
    t = license_scan.Templates(license_scan.with_identifiers(license_scan.TEMPLATES))
    forms = list(license_scan.TEMPLATES.values())
    texts = ["; ".join(f"{prose(100 * seed + i, 37 + 11 * i)} {f}" for i, f in enumerate(forms[seed::4])) for seed in range(4)]
    texts[1] = texts[1].replace(" ", " " + "x" * 9000 + " ", 3) + "y" * 20_000 + " " + forms[0]
    want = list(license_scan.scan_texts(texts, t))
    monkeypatch.setattr(license_scan, "SIGNED", 50)
    for chunk in (700, 3001):
        monkeypatch.setattr(license_scan, "CHUNK", chunk)
        assert list(license_scan.scan_texts(texts, t)) == want
    assert len(want) >= len(forms) - 12


def test_license_scan_memory():
    """A text of 100 million characters takes a small multiple of its bytes."""
    code = """
import resource, sys
from quarry.llm import license_scan as s
t = s.Templates(s.TEMPLATES)
text = b"some words that nobody licensed to anyone " * 2_400_000
text += s.TEMPLATES["MIT"].encode()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert [m[1] for m in s.scan_bytes([text], t)] == ["MIT"]
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT, check=True)
    assert int(out.stdout) < 400


def test_band_tables():
    """Windows are found by their bands alone: as often as the bound on the similarity asks for."""
    many = {f"t{i}": prose(i, 12 + i % 60) for i in range(600)}
    t = license_scan.Templates(many)
    assert t.rows == 2 and t.bands >= license_scan.bands_needed([40], 0.8, 0.9999, 2)
    texts = [f"{prose(1000 + i, 50)} {text} {prose(2000 + i, 30)}" for i, text in enumerate(many.values())]
    got = {(i, n) for i, n, *_ in license_scan.scan_texts(texts, t)}
    assert got >= {(i, n) for i, n in enumerate(many)}


@pytest.mark.parametrize(("text", "licenses"), [
    ("This project is licensed under Apache License 2.0", {"Apache-2.0"}), ("SPDX-License-Identifier: BSD-3-Clause", {"BSD-3-Clause"}),
    ("made available under the terms of the Eclipse Public License - v 2.0", {"EPL-2.0"}),
    ("Licensed under the MIT License.", {"MIT"}), ("Licensed under CC BY 4.0", {"CC-BY-4.0"}), ("Licensed under the ISC License", {"ISC"}),
    ("Licensed under CC0 1.0 Universal", {"CC0-1.0"}), ("This library is under the GNU Lesser General Public License, version 2.1.", {"LGPL-2.1"}),
    ("Licensed under the BSD 3-Clause License", {"BSD-3-Clause"}), ("Licensed under the Mozilla Public License, version 2.0", {"MPL-2.0"}),
    ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"GPL-3.0"}), ("under the GNU General Public License v2", {"GPL-2.0"})])
def test_license_notices(text, licenses):
    t = license_scan.Templates(license_scan.with_identifiers(license_scan.TEMPLATES))
    for whole in (text, prose(1, 45) + " " + text + " " + prose(2, 70)):
        assert {license_scan.license_of(n) for _, n, *_ in license_scan.scan_texts([whole], t)} == licenses


def test_license_versions():
    """Each header is its own license only, also beside another's."""
    t = license_scan.Templates(license_scan.TEMPLATES)
    names = ["GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"]
    of = lambda text: {license_scan.license_of(n) for _, n, *_ in license_scan.scan_texts([text], t)}
    for a in license_scan.TEMPLATES:
        assert of(prose(3, 33) + " " + license_scan.TEMPLATES[a] + " " + prose(4, 50)) >= {license_scan.license_of(a)}
    for a in names:
        assert of(prose(3, 33) + " " + license_scan.TEMPLATES[a] + " " + prose(4, 50)) == {a}
        for b in names:
            assert of(license_scan.TEMPLATES[a] + " " + prose(5, 40) + " " + license_scan.TEMPLATES[b]) == {a, b}
