"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  A line is described by its own features and those of its
neighbours; the chain weighs whether good or bad lines follow each other.  Training lines
carry their document's label.  A document's score is the mean of its lines' marginal
probability of being good, by forward-backward, weighted by line length.  A text beyond CHUNK
characters is scored in runs of lines, a line beyond it in pieces, with the chain's state carried on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.langid import sampled
from quarry.session import bounded, checkpoint_dir

#: Documents of either label in the training sample, on average, and the longest text in it.
SAMPLE, LONGEST = 1000, 100_000
#: Characters of text whose lines are scored at once; lines of a long text whose marginals are taken at once.
CHUNK, BLOCK = 2 << 20, 1 << 16
GOOD_FROM = 0.3

UPPER, LOWER, DIGIT, SPACE, STOP, SIGN, WIDE = range(7)


def _kinds() -> np.ndarray:
    kind = np.full(0x251, WIDE, np.uint8)
    for c in range(0x250):
        s = chr(c)
        kind[c] = (SPACE if s.isspace() else UPPER if s.isupper() else LOWER if s.isalpha() else DIGIT if s.isdigit()
                   else STOP if s in ".,;:?'\"()-" else SIGN if c < 0xC0 else WIDE)
    return kind


KIND = _kinds()
#: Features of a line; the neighbours' are appended.
NAMES = ("bias", "empty", "log_length", "log_words", "word_length", "upper", "digits", "spaces", "stops", "signs", "wide",
         "signs_a_word", "all_caps_words", "doubled_signs", "pipes", "same_line_share", "same_word_share", "ends_stop",
         "starts_upper", "starts_lower", "long_word", "first", "last", "alone")
SAME, FIRST, LAST, ALONE = (NAMES.index(n) for n in ("same_line_share", "first", "last", "alone"))


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features that need no other line, characters of every line, lines of every text, 32-bit hash of every
    line); a text has at least one line."""
    joined = "\n".join(texts)
    code = np.frombuffer((joined + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = KIND[np.minimum(code, 0x250)]
    end = np.flatnonzero(code == 10)
    start = np.concatenate([[0], end[:-1] + 1])
    length = (end - start).astype(np.float64)
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    lines = np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(size)])))

    line = np.repeat(np.arange(len(end), dtype=np.int32), (end + 1 - start))
    count = np.bincount(line * np.int32(8) + kind, minlength=8 * len(end)).reshape(-1, 8).astype(np.float64)
    count[:, SPACE] -= 1  # the line's end

    def total(mask: np.ndarray) -> np.ndarray:
        return np.bincount(line[np.flatnonzero(mask)], minlength=len(end)).astype(np.float64)

    at, stop = _words(kind)  # the text ends with a line's end
    of = line[at]
    words = np.bincount(of, minlength=len(end)).astype(np.float64)
    sign = kind == SIGN
    # Words by a hash, to see repeats inside a line.
    sums = _sums(code)
    key = np.sort((of.astype(np.uint64) << np.uint64(32)) | _spans(sums, at, stop))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    distinct = np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(end))
    longest = np.zeros(len(end))
    if len(at):
        begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        longest[of[begin]] = np.maximum.reduceat(stop - at, begin)
    head = kind[np.minimum(start, len(kind) - 1)]
    tail = kind[np.maximum(end - 1, 0)]
    x = _assembled(length, words, count, total(sign[1:] & sign[:-1]), total(code == 124), distinct, longest, head, tail)
    return x, length, lines, _spans(sums, start, end)


def _words(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of signs other than space; one that reaches the end has its end there."""
    solid = np.concatenate([[False], kind != SPACE, [False]])
    turn = np.flatnonzero(solid[1:] != solid[:-1])
    return turn[::2], turn[1::2]


def _assembled(length, words, count, doubled, pipes, distinct, longest, head, tail) -> np.ndarray:
    """Features NAMES of lines; the share of equal lines and the place in the text are zero yet."""
    per, none = np.maximum(length, 1), np.zeros(len(length))
    n_upper, n_lower, n_signs = count[:, UPPER], count[:, LOWER], count[:, SIGN]
    some = length > 0
    return np.stack([
        np.ones(len(length)), ~some, np.log1p(length) / 8, np.log1p(words) / 6, np.minimum(length / np.maximum(words, 1), 40) / 20,
        n_upper / per * 2, count[:, DIGIT] / per * 2, count[:, SPACE] / per * 2, count[:, STOP] / per * 4, n_signs / per * 4,
        count[:, WIDE] / per, np.minimum(n_signs / np.maximum(words, 1), 4) / 2, (n_upper > 2 * n_lower) & (n_upper > 2),
        doubled / per * 4, pipes / per * 8, none, 1 - distinct / np.maximum(words, 1), some & (tail == STOP),
        some & (head == UPPER), some & (head == LOWER), np.minimum(longest, 60) / 30, none, none, none], axis=1).astype(np.float32)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, characters of every line, lines of every text); a text has at
    least one line."""
    x, length, lines, key = _counted(texts)
    doc = np.repeat(np.arange(len(texts)), lines)
    # Lines by a hash, to see lines that the same text repeats.
    _, number, times = np.unique((doc.astype(np.uint64) << np.uint64(32)) | key, return_inverse=True, return_counts=True)
    x[:, SAME] = (times[number] - 1) / np.maximum(lines[doc], 1) * (length > 0)
    edge = np.cumsum(lines)
    x[edge - lines, FIRST], x[edge - 1, LAST] = 1, 1
    x[:, ALONE] = x[:, FIRST] * x[:, LAST]
    return x, length, lines


def _long_line(text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As _counted for text[start:end], one line of any length, a piece of CHUNK characters at a time."""
    count, doubled, pipes, longest, words = np.zeros(8), 0, 0, 0, 0
    keys, head, tail = np.zeros(0, np.uint64), None, SPACE
    whole, word = _Span(), _Span()
    for at in range(start, end, CHUNK):
        code = np.frombuffer(text[at:min(end, at + CHUNK)].encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = KIND[np.minimum(code, 0x250)]
        count += np.bincount(kind, minlength=8)
        sign = kind == SIGN
        doubled += int(np.count_nonzero(sign[1:] & sign[:-1])) + int(tail == SIGN and sign[0])
        pipes += int(np.count_nonzero(code == 124))
        head = kind[0] if head is None else head
        sums = _sums(code)
        whole.extend(sums, 0, len(code))
        a, b = _words(kind)
        done = []
        if word.length and (not len(a) or a[0] > 0):  # the open word ended with the piece before
            done.append(word)
            word = _Span()
        if len(a):
            longest = max(longest, int((b - a).max()))
            lone = [0] if word.length else []
            if b[-1] == len(code) and lone != [len(a) - 1]:
                lone.append(len(a) - 1)  # may go on in the next piece
            inner = slice(len(lone) and int(lone[0] == 0), len(a) - int(bool(lone) and lone[-1] == len(a) - 1))
            for i in lone:
                word.extend(sums, int(a[i]), int(b[i]))
                if b[i] < len(code):
                    done.append(word)
                    word = _Span()
            keys = np.unique(np.concatenate([keys, _spans(sums, a[inner], b[inner])]))
            words += len(a[inner])
        tail = kind[-1]
        for w in done:
            words, longest, keys = words + 1, max(longest, w.length), np.append(keys, w.key())
    if word.length:
        words, longest, keys = words + 1, max(longest, word.length), np.append(keys, word.key())
    one = lambda v: np.array([v], np.float64)
    x = _assembled(one(end - start), one(words), count[None], one(doubled), one(pipes), one(len(np.unique(keys))), one(longest),
                   np.array([head]), np.array([tail]))
    return x, one(end - start), np.array([1]), np.array([whole.key()], np.uint64)


class _Span:
    """Hash of a span of code points that is read in pieces, equal to that of _spans."""

    def __init__(self):
        self.sum, self.length = 0, 0

    def extend(self, sums: tuple[np.ndarray, np.ndarray], start: int, end: int) -> None:
        flat, placed = (int(v[end]) - int(v[start]) for v in sums)
        self.sum += placed + flat * (self.length - start)
        self.length += end - start

    def key(self) -> np.uint64:
        return _closed(np.array([self.sum & (1 << 64) - 1], np.uint64), np.array([self.length]))[0]


def _sums(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of hashed characters, plain and weighed by their place."""
    h = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    flat, placed = np.zeros(len(h) + 1, np.uint64), np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h, out=flat[1:])
    h *= np.arange(1, len(h) + 1, dtype=np.uint64)
    np.cumsum(h, out=placed[1:])
    return flat, placed


def _spans(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """32-bit hash of each span of code points, from differences of the running sums."""
    flat, placed = sums
    return _closed((placed[end] - placed[start]) - (flat[end] - flat[start]) * start.astype(np.uint64), end - start)


def _closed(out: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = out + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Own features, then those of the line before and the line after (zero at the ends)."""
    edge = np.cumsum(lines)
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[edge - lines], after[edge - 1] = 0, 0
    return np.concatenate([x, before, after], axis=1)


def _running(m: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Products m[s] ... m[t] of 2x2 matrices from the start of each chain to each t, scaled to
    a sum of 1, by doubling: as many rounds as the longest chain has binary digits."""
    p, reach, longest = m.copy(), 1, int(place.max(initial=0)) + 1
    while reach < longest:
        own = np.flatnonzero(place >= reach)
        q = np.einsum("nab,nbc->nac", p[own - reach], p[own])
        p[own] = q / q.sum(axis=(1, 2), keepdims=True)
        reach *= 2
    return p


def marginals(unary: np.ndarray, step: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """unary (lines x 2 scores), step (2 x 2 transition scores) -> (marginals of each line, marginals
    of each pair of adjacent lines within a chain, index of each pair's second line)."""
    n = len(unary)
    place = np.arange(n) - np.repeat(np.cumsum(lines) - lines, lines)
    to_end = np.repeat(lines, lines) - 1 - place
    u = np.exp(unary - unary.max(axis=1, keepdims=True))
    t = np.exp(step - step.max())
    into = t[None] * u[:, None, :]
    into[place == 0] = u[place == 0][:, None, :] * 0.5
    into /= into.sum(axis=(1, 2), keepdims=True)
    alpha = _running(into, place).sum(axis=1)
    out = (t[None] * u[:, None, :]).transpose(0, 2, 1)[::-1]  # backward: chains read from their ends
    out = out / out.sum(axis=(1, 2), keepdims=True)
    back = _running(out, to_end[::-1])[::-1]
    beta = np.ones((n, 2))
    inner = np.flatnonzero(to_end > 0)
    beta[inner] = back[inner + 1].sum(axis=1)
    one = alpha * beta
    one /= one.sum(axis=1, keepdims=True)
    second = np.flatnonzero(place > 0)
    pair = alpha[second - 1][:, :, None] * t[None] * (u[second] * beta[second])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return one, pair, second


def _runs(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """_counted of runs of whole lines of about CHUNK characters."""
    at = 0
    while at <= len(text):
        cut = len(text) if len(text) - at <= CHUNK else text.rfind("\n", at, at + CHUNK)
        if cut >= 0:
            yield _counted([text[at:cut]])
        else:
            cut = text.find("\n", at + CHUNK)
            cut = len(text) if cut < 0 else cut
            yield _long_line(text, at, cut)
        at = cut + 1


def chain_means(unary: np.ndarray, step: np.ndarray, weight: np.ndarray) -> float:
    """Weighted mean of the second state's marginals in one chain, BLOCK lines at a time."""
    t = np.exp(step - step.max())

    def moves(low: int, high: int) -> np.ndarray:
        own = unary[low:high]
        m = t[None] * np.exp(own - own.max(axis=1, keepdims=True))[:, None, :]
        if low == 0:
            m[0] = m[0] / t * 0.5
        return m / m.sum(axis=(1, 2), keepdims=True)

    starts, before, forward = range(0, len(unary), BLOCK), np.ones(2), []
    for low in starts:
        forward.append(before)
        m = moves(low, low + BLOCK)
        before = before @ _running(m, np.arange(len(m)))[-1]
        before = before / before.sum()
    total, after = 0.0, np.ones(2)
    for low in reversed(starts):
        m = moves(low, low + BLOCK)
        alpha = forward[low // BLOCK] @ _running(m, np.arange(len(m)))
        back = _running(m.transpose(0, 2, 1)[::-1], np.arange(len(m)))[::-1]  # products to the block's end, transposed
        reach = after @ back
        beta = np.concatenate([reach[1:] / reach[1:].sum(axis=1, keepdims=True), after[None]])
        one = alpha * beta
        total += float((one[:, 1] / one.sum(axis=1) * weight[low:low + BLOCK]).sum())
        after = reach[0] / reach[0].sum()
    return total / float(weight.sum())


@dataclass
class LineCrf:
    weights: np.ndarray  # features x 2
    step: np.ndarray  # 2 x 2, from row to column; 1 is good

    def scores(self, texts: list[str]) -> np.ndarray:
        """Score of each text; the result does not depend on the texts beside it, nor on CHUNK but for rounding."""
        out = np.array([self._long(t) if len(t) > CHUNK else 0.0 for t in texts])
        short = [i for i, t in enumerate(texts) if len(t) <= CHUNK]
        if not short:
            return out
        x, length, lines = line_features([texts[i] for i in short])
        one, _, _ = marginals(with_neighbours(x, lines) @ self.weights, self.step, lines)
        weight = length + (np.repeat(np.add.reduceat(length, np.cumsum(lines) - lines), lines) == 0)
        at = np.cumsum(lines) - lines
        out[short] = np.add.reduceat(one[:, 1] * weight, at) / np.add.reduceat(weight, at)
        return np.clip(out, 0, 1)

    def _long(self, text: str) -> float:
        n = text.count("\n") + 1
        key, length, at = np.zeros(n, np.uint32), np.zeros(n, np.int64), 0
        for _, size, _, own in _runs(text):
            key[at:at + len(own)], length[at:at + len(own)] = own, size
            at += len(own)
        known, times = np.unique(key, return_counts=True)
        unary, at, k = np.zeros((n, 2)), 0, len(NAMES)
        for x, size, _, own in _runs(text):
            x[:, SAME] = (times[np.searchsorted(known, own.astype(np.uint32))] - 1) / n * (size > 0)
            if at == 0:
                x[0, FIRST] = 1
            if at + len(x) == n:
                x[-1, LAST] = 1
            x[:, ALONE] = x[:, FIRST] * x[:, LAST]
            end = at + len(x)
            unary[at:end] += x @ self.weights[:k]
            unary[at + 1:end + 1] += x[:n - at - 1] @ self.weights[k:2 * k]  # as the line before
            unary[max(0, at - 1):end - 1] += x[at == 0:] @ self.weights[2 * k:]  # as the line after
            at = end
        weight = length.astype(np.float64) if length.any() else np.ones(n)
        return min(1.0, max(0.0, chain_means(unary, self.step, weight)))


def train_crf(texts: list[str], label: np.ndarray, rounds: int = 150, rate: float = 0.05, l2: float = 1e-4) -> LineCrf:
    """Maximise the conditional likelihood of the line labels by Adam on the whole sample."""
    x, length, lines = line_features(texts)
    x = with_neighbours(x, lines).astype(np.float64)
    y = np.repeat(label, lines)
    model = [np.zeros((x.shape[1], 2)), np.zeros((2, 2))]
    first, square = [np.zeros_like(a) for a in model], [np.zeros_like(a) for a in model]
    gold = np.eye(2)[y]
    share = 1 / np.repeat(lines, lines)  # every document counts the same
    for k in range(1, rounds + 1):
        one, pair, second = marginals(x @ model[0], model[1], lines)
        grads = [x.T @ ((one - gold) * share[:, None]) / len(texts) + l2 * model[0],
                 ((pair - gold[second - 1][:, :, None] * gold[second][:, None, :]) * share[second, None, None]).sum(axis=0) / len(texts) + 0.01 * model[1]]
        for a, g, m, v in zip(model, grads, first, square, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-9)
    return LineCrf(*model)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> LineCrf | None:
    """Fit on documents (doc_id, text) with a quality in ``labels`` (doc_id, quality); None without any.

    About ``sample`` documents of either label, drawn by a hash of doc_id and never more than twice as
    many, of at most ``longest`` characters; texts are read whole, equal rows once."""
    checkpoint_dir(docs.sparkSession)
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if not counts:
        return None
    drawn = bounded(sampled(known, counts, "quality", sample, ("doc_id",)).drop("key"), 8 * sample)
    # Only drawn documents travel to the join.  Those of repeated ids are cut to the bound again.
    rows = docs.select("doc_id", "text").where(F.char_length("text") <= longest).join(drawn, "doc_id")
    rows = sampled(rows, {k: 1 for k in counts}, "quality", sample).select("doc_id", "text", "quality")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        held.sort(key=lambda r: (r[0], r[1]))
        if held:
            m = train_crf([r[1] for r in held], np.array([r[2] for r in held]))
            yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()]), pa.array([m.step.tobytes()])], ["w", "t"])

    got = rows.repartition(1).mapInArrow(fit, "w binary, t binary").collect()  # the bounded sample; one row back
    if not got:
        return None
    return LineCrf(np.frombuffer(got[0]["w"]).reshape(-1, 2), np.frombuffer(got[0]["t"]).reshape(2, 2))


def score(docs: DataFrame, model: LineCrf | None, keep: tuple = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The ``keep`` columns and score (0 to 1) of each row; null text counts as one empty line,
    and without a model every score is 0.5."""
    checkpoint_dir(docs.sparkSession)
    src = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, part, size = [], [], 0

            def flush():
                if part:
                    out.append(held.value.scores(part) if held.value else np.full(len(part), 0.5))
                part.clear()

            for t in b.column(b.num_columns - 1):
                s = t.as_py()
                if size + len(s) > CHUNK:
                    flush()
                    size = 0
                part.append(s)
                size += len(s)
            flush()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(out) if out else np.zeros(0))], [*keep, "score"])

    schema = src.drop("_text").withColumn("score", F.lit(0.0)).schema
    return src.mapInArrow(run, schema)


def held_out(remainder: int, parts: int):
    """True for rows whose crc32(doc_id as text) leaves ``remainder``; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == remainder, F.lit(True))


def quality(docs: DataFrame, labels: DataFrame, good_from: float = GOOD_FROM) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.  Learns labels only from rows
    that are not held out; labels, lang, source and doc_id play no part in a score.  Repeated
    rows stay repeated, an empty table gives an empty result, very long texts are scored whole, other columns are not read."""
    rows = docs.withColumn("held_out", held_out(0, 5))
    model = train(docs, labels.where(~held_out(0, 5)))
    out = score(rows, model, ("doc_id", "held_out"))
    return out.withColumn("predicted", (F.col("score") >= good_from).cast("int"))
