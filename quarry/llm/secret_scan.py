"""Secrets in texts: known patterns, and formats inferred from what these patterns find.

Credentials found by the patterns are the labelled examples.  For each kind a prefix tree of a
bounded sample is turned into a probabilistic automaton by merging states whose end and symbol
frequencies agree within Hoeffding's bound (ALERGIA).  One more automaton is inferred from ordinary tokens.
Every other token of a text is a candidate: it is added to the kind whose automaton gives
its format the largest likelihood, if that is as likely as labelled credentials are and clearly
likelier than as an ordinary token.  Letters are folded, so copies in another case are found.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.memory import tidy
from quarry.session import checkpoint_dir, write_table

KINDS = ("assign", "access", "hex")
#: Fixed patterns of the three kinds; an assignment's credential is its second group.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: Shortest credential of each kind; words of which one stands in every assignment.
SHORTEST = (12, 18, 16)
NAMED = ("passw", "secret", "token", "api")
#: Labelled credentials of a kind, and ordinary tokens, that automata are inferred from; the longest
#: of them; fewer than FEWEST give no automaton.
SAMPLE, LONGEST, FEWEST = 1000, 200, 20
#: Confidence of the merge test; counts added to every symbol; how far below the labelled credentials' mean
#: an accepted token may be (standard deviations, and nats a symbol at least); least advantage over an ordinary
#: token (nats a symbol).
ALPHA, SMOOTH, SPREAD, SLACK, MARGIN = 0.05, 0.05, 4.0, 0.1, 0.5
#: Candidates scored at once.
CHUNK = 20_000

SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SYMBOL = np.zeros(256, np.intp)
for _i, _c in enumerate(SIGNS):
    SYMBOL[ord(_c)] = SYMBOL[ord(_c.upper())] = _i


def scan(text: str) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, str]]]:
    """(base spans (start, kind, end, credential) by start and kind, candidates (start, token)): candidates
    are the tokens that no base span touches."""
    base = []
    folded = text.lower()
    if any(w in folded for w in NAMED):
        base += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= SHORTEST[0]]
    del folded
    tokens = []
    for m in TOKEN.finditer(text):  # an access key or hex run lies within a token
        token, at = m[0], m.start()
        if len(token) >= SHORTEST[2]:
            base += [(at + h.start(), 2, at + h.end(), h[0]) for h in HEX.finditer(token)]
            if "AKIA" in token:
                base += [(at + h.start(), 1, at + h.end(), h[0]) for h in ACCESS.finditer(token)]
        tokens.append((at, token))
    base.sort()
    if base:
        free, i, reach = [], 0, -1
        for at, token in tokens:  # spans in order of start; ``reach`` is the furthest end so far
            while i < len(base) and base[i][0] < at + len(token):
                reach = max(reach, base[i][2])
                i += 1
            if reach <= at:
                free.append((at, token))
        tokens = free
    trimmed = []
    for at, token in tokens:
        own = token.lstrip(".-_/")
        at += len(token) - len(own)
        own = own.rstrip(".-_/")
        if len(own) >= min(SHORTEST):
            trimmed.append((at, own))
    return base, trimmed


@dataclass
class Automaton:
    """Probabilistic automaton over SIGNS: next state, log probability of each symbol and of the end."""
    follow: np.ndarray
    log: np.ndarray
    log_end: np.ndarray

    def mean_log(self, words: list[np.ndarray]) -> np.ndarray:
        """Mean log likelihood a symbol (the end counts as one) of words of symbols, all at once."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-length, kind="stable")
        flat = np.concatenate([words[i] for i in order]) if len(words) else np.zeros(0, np.intp)
        size = length[order]
        first = np.cumsum(size) - size
        state, total = np.zeros(len(words), np.intp), np.zeros(len(words))
        for k in range(int(size[0]) if len(size) else 0):
            n = np.searchsorted(-size, -k)  # words of more than k symbols
            s, c = state[:n], flat[first[:n] + k]
            total[:n] += self.log[s, c]
            state[:n] = self.follow[s, c]
        out = np.empty(len(words))
        out[order] = (total + self.log_end[state]) / (size + 1)
        return out


class _Tree:
    """Prefix tree of a sample whose states are merged step by step."""

    def __init__(self, sample: list[str]):
        self.visits, self.ends, self.child, self.count = [0], [0], [{}], [{}]
        for word in sample:
            at = 0
            self.visits[0] += 1
            for c in SYMBOL[np.frombuffer(word.encode(), np.uint8)].tolist():
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c not in self.child[at]:
                    self.child[at][c] = len(self.visits)
                    self.visits.append(0)
                    self.ends.append(0)
                    self.child.append({})
                    self.count.append({})
                at = self.child[at][c]
                self.visits[at] += 1
            self.ends[at] += 1

    def _differ(self, f: int, n: int, g: int, m: int, bound: float) -> bool:
        return abs(f / n - g / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(self, red: int, blue: int, bound: float) -> bool:
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            n, m = self.visits[a], self.visits[b]
            if self._differ(self.ends[a], n, self.ends[b], m, bound):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if self._differ(self.count[a].get(c, 0), n, self.count[b].get(c, 0), m, bound):
                    return False
            todo += [(self.child[a][c], d) for c, d in self.child[b].items() if c in self.child[a]]
        return True

    def fold(self, red: int, blue: int) -> None:
        """Add the blue subtree to the states that its words reach from ``red``."""
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
            for c, d in self.child[b].items():
                if c in self.child[a]:
                    todo.append((self.child[a][c], d))
                else:
                    self.child[a][c] = d


def infer(sample: list[str], alpha: float = ALPHA, smooth: float = SMOOTH) -> Automaton:
    """Automaton of ``sample`` (words over SIGNS, letters of either case): states of the prefix tree are
    merged into the first settled state that they are statistically compatible with, the most visited first."""
    tree = _Tree(sorted(sample))
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    red, settled = [0], {0}
    while True:
        blue = [(-tree.visits[d], d, a, c) for a in red for c, d in tree.child[a].items() if d not in settled]
        if not blue:
            break
        _, d, a, c = min(blue)
        into = next((r for r in red if tree.compatible(r, d, bound)), None)
        if into is None:
            red.append(d)
            settled.add(d)
        else:
            tree.child[a][c] = into
            tree.fold(into, d)
    number = {s: i for i, s in enumerate(red)}
    k = len(SIGNS)
    follow, log, end = np.zeros((len(red), k), np.intp), np.zeros((len(red), k)), np.zeros(len(red))
    for s, i in number.items():
        whole = tree.visits[s] + smooth * (k + 1)
        end[i] = math.log((tree.ends[s] + smooth) / whole)
        for c in range(k):
            log[i, c] = math.log((tree.count[s].get(c, 0) + smooth) / whole)
            follow[i, c] = number[tree.child[s][c]] if c in tree.child[s] else 0
    return Automaton(follow, log, end)


def _symbols(words: list[str]) -> list[np.ndarray]:
    return [SYMBOL[np.frombuffer(w.encode(), np.uint8)] for w in words]


@dataclass
class Formats:
    """An automaton, least mean log likelihood, and shortest and longest credential of each kind learned."""
    kinds: dict[int, tuple[Automaton, float, int, int]]
    ordinary: Automaton

    def classify(self, tokens: list[str]) -> np.ndarray:
        """Kind of each token, -1 for none."""
        out = np.full(len(tokens), -1)
        if not self.kinds:
            return out
        length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        low, high = min(k[2] for k in self.kinds.values()), max(k[3] for k in self.kinds.values())
        use = np.flatnonzero((length >= low) & (length <= high))
        if not len(use):
            return out
        words = _symbols([tokens[i] for i in use])
        least = self.ordinary.mean_log(words) + MARGIN
        best = np.full(len(use), -np.inf)
        for kind, (automaton, floor, shortest, longest) in sorted(self.kinds.items()):
            got = automaton.mean_log(words)
            fits = (got >= floor) & (got >= least) & (got > best) & (length[use] >= shortest) & (length[use] <= longest)
            out[use[fits]], best[fits] = kind, got[fits]
        return out


def learn(credentials: list[list[str]], ordinary: list[str]) -> Formats:
    """Automata of the labelled credentials of each kind; one in five sets the least likelihood."""
    kinds = {}
    for kind, words in enumerate(credentials):
        words = sorted(words, key=lambda w: (zlib.crc32(w.encode()), w))
        if len(words) < FEWEST:
            continue
        apart, used = words[::5], [w for i, w in enumerate(words) if i % 5]
        automaton = infer(used)
        usual = automaton.mean_log(_symbols(apart))
        floor = float(usual.mean() - max(SPREAD * usual.std(), SLACK))
        kinds[kind] = (automaton, floor, min(map(len, words)), max(map(len, words)))
    return Formats(kinds, infer(ordinary))


def _sampled(docs: DataFrame, text_col: str, sample: int, longest: int) -> list[list[str]]:
    """For each kind, and for ordinary tokens last, the ``sample`` distinct strings of least hash."""
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, below = [set() for _ in range(len(KINDS) + 1)], [(1 << 32, "")] * (len(KINDS) + 1)

        def cut(kind: int) -> None:
            if len(held[kind]) > sample:
                kept = sorted(held[kind])[:sample]
                held[kind], below[kind] = set(kept), kept[-1]

        for b in batches:
            for v in b.column(0):
                base, free = scan(v.as_py() or "")
                for kind, word in [*((k, w) for _, k, _, w in base), *((len(KINDS), w) for _, w in free)]:
                    if len(word) <= longest and (key := (zlib.crc32(word.encode()), word)) < below[kind]:
                        held[kind].add(key)
                        if len(held[kind]) >= 2 * sample + 64:
                            cut(kind)
        for kind in range(len(held)):
            cut(kind)
        rows = [(k, *key) for k, of in enumerate(held) for key in sorted(of)]
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["kind", "hash", "word"])

    found = write_table(docs.select(text_col).mapInArrow(tidy(draw), "kind bigint, hash bigint, word string"), "credentials")
    return [[r["word"] for r in found.where(F.col("kind") == k).select("hash", "word").distinct().orderBy("hash", "word").limit(sample).collect()]
            for k in range(len(KINDS) + 1)]  # bounded samples of short strings


def scan_secrets(docs: DataFrame, sample: int = SAMPLE, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, n_assign, n_access, n_hex (matches of the patterns), base_sha256
    (of these matches as kind:start:end, by start and kind, comma-joined) and spans (these and the added ones,
    written alike).

    Places are code points of the whole text.  Automata are inferred from at most ``sample``
    distinct credentials a kind, and as many ordinary tokens, of at most ``longest`` signs, those of least hash among
    all documents; a kind with fewer than FEWEST adds nothing.  An added token is no shorter and no longer than
    the kind's sample.  Null text is empty; null ids stay null; repeated rows are reported each; an
    empty table gives an empty result; very long texts are scanned whole, their candidates in groups; among equally
    likely kinds the first one counts; other columns are not read."""
    checkpoint_dir(docs.sparkSession)
    words = _sampled(docs, text_col, sample, longest)
    held = docs.sparkSession.sparkContext.broadcast(learn(words[:-1], words[-1]))  # inferred from bounded samples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formats = held.value
        for b in batches:
            found, places, tokens = [], [], []

            def score():
                for (row, at, n), kind in zip(places, formats.classify(tokens).tolist(), strict=True):
                    if kind >= 0:
                        found[row][1].append((at, kind, at + n))
                places.clear()
                tokens.clear()

            for v in b.column(1):
                base, free = scan(v.as_py() or "")
                found.append(([s[:3] for s in base], []))
                for at, token in free:
                    places.append((len(found) - 1, at, len(token)))
                    tokens.append(token)
                    if len(tokens) >= CHUNK:
                        score()
            score()
            n = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(len(KINDS))]
            text = [[",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans)) for spans in (base, base + more)] for base, more in found]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in n),
                                              pa.array([hashlib.sha256(t[0].encode()).hexdigest() for t in text], pa.string()),
                                              pa.array([t[1] for t in text], pa.string())], [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    src = docs.select(id_col, text_col)
    return src.mapInArrow(tidy(run), src.select(id_col, *[F.lit(0).cast("bigint").alias(f"n_{k}") for k in KINDS], F.lit("").alias("base_sha256"), F.lit("").alias("spans")).schema)
