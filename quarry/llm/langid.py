"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, what is not a letter becomes a space, and n-grams of one to three
characters are hashed into ``BUCKETS`` columns.  Document frequencies come from all learnable
documents.  Weights are trained on a bounded sample by follow-the-regularised-leader with
elastic-net penalties (FTRL-proximal), which leaves most of them zero; part of the sample is
kept apart to fit the temperature that calibrates the probabilities.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.memory import tidy
from quarry.session import checkpoint_dir

#: Columns of the hashed n-grams; documents of one language in the training sample, on average.
BUCKETS, SAMPLE = 1 << 14, 1200
#: Characters hashed at once, and documents counted at once.
CHUNK, ROWS = 1 << 20, 16
UNDETERMINED = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """1 for every code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_codes(text: str) -> np.ndarray:
    """Lower-case code points with single spaces for all else, a space at either end; empty if
    there is no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return code[:0]
    code = np.where(letter, code, np.uint32(32))
    keep = letter | np.concatenate([[True], letter[:-1]])
    code = code[keep]
    ends = [np.array([32], np.uint32)] if code[0] != 32 else [], [np.array([32], np.uint32)] if code[-1] != 32 else []
    return np.concatenate([*ends[0], code, *ends[1]])


def gram_columns(code: np.ndarray) -> Iterator[np.ndarray]:
    """Columns of all n-grams (n = 1, 2, 3) of one text, in runs of CHUNK characters."""
    for at in range(0, len(code), CHUNK):
        c = code[at:at + CHUNK + 2]
        own = min(CHUNK, len(code) - at)
        h = c * np.uint32(0x9E3779B1)
        for n in range(3):
            if n:
                h = h[:-1] * np.uint32(0x85EBCA6B) + c[n:] * np.uint32(0xC2B2AE35) + np.uint32(n)
            x = h[:own] ^ (h[:own] >> np.uint32(15))
            yield (x * np.uint32(0x2C1B3C6D) >> np.uint32(32 - 14)).astype(np.int32)


def term_counts(text: str | None) -> np.ndarray:
    """Counts of a text's n-grams by column (float32); all zero without letters."""
    out = np.zeros(BUCKETS, np.float32)
    for cols in gram_columns(letter_codes(text or "")):
        out += np.bincount(cols, minlength=BUCKETS)
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, counts: np.ndarray) -> np.ndarray:
        x = counts * self.idf
        return x / np.maximum(np.sqrt((x * x).sum(axis=-1, keepdims=True)), 1e-12)

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        z = (self.features(counts) @ self.weights + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train_ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int, epochs: int = 3,
               alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over sparse rows (columns, values): (weights BUCKETS x classes, bias)."""
    z, n = np.zeros((BUCKETS + 1, n_classes)), np.zeros((BUCKETS + 1, n_classes))

    def weights(zc, nc):
        return np.where(np.abs(zc) <= l1, 0.0, -(zc - np.sign(zc) * l1) / ((beta + np.sqrt(nc)) / alpha + l2))

    order = np.arange(len(x))
    for epoch in range(epochs):
        np.random.default_rng(epoch).shuffle(order)
        for i in order:
            cols = np.append(x[i][0], BUCKETS)  # the last column is the bias
            v = np.append(x[i][1], 1.0)
            zc, nc = z[cols], n[cols]
            w = weights(zc, nc)
            p = np.exp((s := v @ w) - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = v[:, None] * p
            z[cols] = zc + g - (np.sqrt(nc + g * g) - np.sqrt(nc)) / alpha * w
            n[cols] = nc + g * g
    w = weights(z, n)
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by golden section on its logarithm."""
    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    low, high, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    a, b = high - r * (high - low), low + r * (high - low)
    for _ in range(40):
        if loss(a) < loss(b):
            high, b = b, a
            a = high - r * (high - low)
        else:
            low, a = a, b
            b = low + r * (high - low)
    return float(np.exp((low + high) / 2))


def _document_frequency(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold each column, documents) over all rows of ``texts`` (text)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for t in b.column(0):
                df += term_counts(t.as_py()) > 0
                n += 1
        cols = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(cols, -1)), pa.array(np.append(df[cols], n))], ["col", "n"])

    out, n = np.zeros(BUCKETS), 0
    for r in texts.mapInArrow(tidy(count), "col bigint, n bigint").groupBy("col").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS + 1 rows
        if r["col"] < 0:
            n = r["n"]
        else:
            out[r["col"]] = r["n"]
    return out, n


def sampled(rows: DataFrame, counts: dict, by: str, sample: int, columns: tuple = ("doc_id", "text")) -> DataFrame:
    """About ``sample`` of ``rows`` for each value of ``by`` (``counts``: how many there are), with ``key``, the hash
    of ``columns`` that draws them.  Rows of equal columns count once; at most twice the sample stays."""
    full = (1 << 63) - 1
    limit = F.create_map(*[F.lit(x) for k, c in counts.items() for x in (k, min(full, full * sample // c))])
    key = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), *columns), 1)
    drawn = rows.withColumn("key", key).where(F.col("key") <= limit[F.col(by)]).dropDuplicates(["key", by])
    place = F.row_number().over(W.partitionBy(by).orderBy("key"))
    return drawn.withColumn("place", place).where(F.col("place") <= 2 * sample).drop("place")


def train(learnable: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    """Fit on rows (doc_id, text, lang) that may be learned from; None if no lang is known.

    Document frequencies count every row.  Weights and temperature use about ``sample`` rows a
    language and never more than twice as many, drawn by a hash of doc_id and text, equal ones once; their
    texts are read whole."""
    checkpoint_dir(learnable.sparkSession)
    known = learnable.where("lang IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    df, n = _document_frequency(learnable.select("text"))
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 1, 0).astype(np.float32)
    drawn = sampled(known, counts, "lang", sample).select("key", "text", "lang")
    number = {k: i for i, k in enumerate(languages)}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [term_counts(t.as_py()) for t in b.column(1)]
            cols = [np.flatnonzero(r).astype(np.int32) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(cols, pa.list_(pa.int32())), pa.array([r[c] for r, c in zip(rows, cols, strict=True)], pa.list_(pa.float32()))], ["key", "lang", "cols", "counts"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            rows += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), [np.array(v) for v in b.column(2).to_numpy(zero_copy_only=False)], [np.array(v) for v in b.column(3).to_numpy(zero_copy_only=False)], strict=True)
        rows = sorted((r for r in rows if len(r[2])), key=lambda r: (r[0], r[1]))
        if not rows:
            return
        y = np.array([number[r[1]] for r in rows])
        x = []
        for _, _, cols, tf in rows:
            v = tf * idf[cols]
            x.append((cols, v / max(np.sqrt(v @ v), 1e-12)))
        apart = np.arange(len(rows)) % 5 == 4  # one in five rows fits the temperature
        learn = np.flatnonzero(~apart)
        w, bias = train_ftrl([x[i] for i in learn], y[learn], len(languages))
        held = np.flatnonzero(apart)
        t = fit_temperature(np.array([v @ w[c] + bias for c, v in (x[i] for i in held)]), y[held]) if len(held) else 1.0
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()]), pa.array([bias.tobytes()]), pa.array([t])], ["w", "bias", "t"])

    got = (drawn.mapInArrow(tidy(sparse), "key bigint, lang string, cols array<int>, counts array<float>")
           .repartition(1).mapInArrow(tidy(fit), "w binary, bias binary, t double").collect())  # the bounded sample; one row back
    if not got:
        return None
    r = got[0]
    return LanguageModel(languages, idf, np.frombuffer(r["w"], np.float32).reshape(BUCKETS, -1), np.frombuffer(r["bias"]).astype(np.float32), r["t"])


def predict(docs: DataFrame, model: LanguageModel | None, keep: tuple = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The ``keep`` columns, lang_pred and score (the calibrated probability, 0 to 1) of each row.

    A text that is null or has no letters is ``und`` with score 0, as is every text without a model."""
    checkpoint_dir(docs.sparkSession)
    own = list(keep).index(text_col) if text_col in keep else len(keep)
    src = docs.select(*keep) if text_col in keep else docs.select(*keep, F.col(text_col).alias("_text"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            pred, score = [UNDETERMINED] * b.num_rows, np.zeros(b.num_rows)
            text, row, x = b.column(own), [], []

            def flush():
                if row:
                    p = m.probabilities(np.stack(x))
                    best = p.argmax(axis=1)
                    for i, k, s in zip(row, best, p[np.arange(len(row)), best], strict=True):
                        pred[i], score[i] = m.languages[k], min(1.0, float(s))
                    row.clear()
                    x.clear()

            for i, t in enumerate(text):
                counts = term_counts(t.as_py()) if m else None
                if m and counts.any():
                    row.append(i)
                    x.append(counts)
                    if len(row) == ROWS:
                        flush()
            flush()
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(pred), pa.array(score)], [*keep, "lang_pred", "score"])

    schema = src.select(*keep).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return src.mapInArrow(tidy(run), schema)


def held_out(remainder: int, parts: int):
    """True for rows whose crc32(doc_id as text) leaves ``remainder``; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == remainder, F.lit(True))


def identify(docs: DataFrame, sample: int = SAMPLE, keep: tuple = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the ``keep`` columns, held_out, lang_pred, score.  Learns from
    text and non-null lang of rows that are not held out; lang, source and doc_id play no part in a
    prediction.  An empty table gives an empty result; extra columns are not read."""
    rows = docs.withColumn("held_out", held_out(1, 3))
    model = train(rows.where("NOT held_out").select("doc_id", "text", "lang"), sample)
    return predict(rows, model, (*keep, "held_out"))


def accepted(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language is determined, with a score of at least ``least``."""
    names = [f"_q{i}" for i in range(len(docs.columns))]  # clear of the columns that are added
    own = dict(zip(docs.columns, names, strict=True))
    rows = docs.toDF(*names)
    needed = rows.select(*[F.col(own[c]).alias(c) for c in ("doc_id", "text", "lang")]).where(~held_out(1, 3))
    marked = predict(rows, train(needed), tuple(names), own["text"])
    return marked.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select(*names).toDF(*docs.columns)
