"""Ranked lexical search by scanning documents with an Aho-Corasick automaton.

The automaton holds all terms of all items, each between two boundary signs, and is broadcast.  A
first scan counts, directly from the texts, the documents that hold each term and the length of
each document; a second one counts the terms again and scores each document for the items that the
automaton's outputs map to.  A task keeps the best documents of each item only.  There is no index
of the documents.  Items whose terms exceed a measured bound are dealt over several automata.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.bytewords import GAP, column_bytes, word_table
from quarry.llm.memory import tidy
from quarry.session import checkpoint_dir, write_table

#: Bytes of terms in one automaton, and bytes of text scanned at once.
TERM_BYTES, CHUNK = 8 << 20, 1 << 20
WORDS = word_table(b"0123456789abcdefghijklmnopqrstuvwxyz")


def terms_of(text: str | None) -> list[str]:
    """Distinct terms, in order; each as a string of one character a byte."""
    return list(dict.fromkeys(w.decode("latin-1") for w in (text or "").encode().translate(WORDS).split(GAP) if w))


@functools.lru_cache(maxsize=2)
def automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    """Finds each term with a boundary on either side; its output is the term's number."""
    a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, t in enumerate(terms):
        a.add_word(f"\x00{t}\x00", i)
    a.make_automaton()
    return a


def _stretches(raw: bytes) -> Iterator[bytes]:
    """A normalised text cut between words, with a boundary at either end of each piece."""
    at = 0
    while at < len(raw):
        cut = raw.find(GAP, at + CHUNK)
        cut = len(raw) if cut < 0 else cut
        yield GAP + raw[at:cut] + GAP
        at = cut


def counts_in(raw: bytes, terms: tuple[str, ...]) -> tuple[int, np.ndarray, np.ndarray]:
    """(terms of the text with repeats, numbers of the automaton's terms that occur, how often)."""
    n, found = 0, []
    for piece in _stretches(raw.translate(WORDS)):
        inside = np.frombuffer(piece, np.uint8) != 0
        n += int(np.count_nonzero(inside[1:] & ~inside[:-1]))
        if terms:
            hits = np.fromiter((v for _, v in automaton(terms).iter(piece.decode("latin-1"))), np.int64)
            found.append(np.unique(hits, return_counts=True))
    if len(found) == 1:
        return n, *found[0]
    if not found:
        return n, np.zeros(0, np.int64), np.zeros(0, np.int64)
    number, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    return n, number, np.bincount(at, np.concatenate([f[1] for f in found])).astype(np.int64)


class Items:
    """Items (key, terms) as one automaton's terms and, for each term, the items that hold it."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.keys = [k for k, _ in items]
        self.terms = tuple(sorted({t for _, terms in items for t in terms}))
        number = {t: i for i, t in enumerate(self.terms)}
        pairs = sorted((number[t], i) for i, (_, terms) in enumerate(items) for t in terms)
        self.first = np.searchsorted(np.array([p[0] for p in pairs], np.int64), np.arange(len(self.terms) + 1))
        self.item = np.array([p[1] for p in pairs], np.int64)

    def scores(self, number: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Sum over the terms of each item; parts and sums are whole numbers below 2**53."""
        size = self.first[number + 1] - self.first[number]
        at = np.repeat(self.first[number] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self.item[at], np.repeat(part, size), minlength=len(self.keys)).astype(np.int64)


def _statistics(docs: DataFrame, items) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all terms, documents that hold each of the automaton's terms)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = items.value.terms
        df, some, total = np.zeros(len(terms), np.int64), 0, 0
        for b in batches:
            for raw in column_bytes(b.column(0)):
                n, number, _ = counts_in(raw, terms)
                df[number] += 1
                some += n > 0
                total += n
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, [-1, -2])), pa.array(np.append(df[held], [some, total]))], ["term", "n"])

    df, whole = np.zeros(len(items.value.terms), np.int64), {-1: 0, -2: 0}
    for r in docs.select("text").mapInArrow(tidy(count), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row a term
        if r["term"] < 0:
            whole[r["term"]] = r["n"]
        else:
            df[r["term"]] = r["n"]
    return whole[-1], whole[-2], df


class Best:
    """The ``k`` best (score, id, row) of each item: higher score, then smaller id (null last)."""

    def __init__(self, n_items: int, k: int):
        self.k, self.held, self.least = k, [[] for _ in range(n_items)], np.ones(n_items, np.int64)

    def offer(self, scores: np.ndarray, doc: int | None, row: int) -> None:
        for i in np.flatnonzero(scores >= self.least).tolist():
            of = self.held[i]
            of.append((-int(scores[i]), doc is None, doc or 0, row))
            if len(of) > self.k:
                of.sort()
                of.pop()
                self.least[i] = -of[-1][0]

    def rows(self) -> Iterator[tuple[int, int, int | None, int]]:
        for i, of in enumerate(self.held):
            for s, unnamed, doc, row in of:
                yield i, -s, None if unnamed else doc, row


def _search(docs: DataFrame, items: Items, k: int) -> DataFrame:
    """(key, doc_id, row, score): every task's best documents of each item."""
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast(items)
    n_docs, total, df = _statistics(docs, held)
    weight = sc.broadcast(np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = held.value, weight.value
        best = Best(len(own.keys), k)
        for b in batches:
            ids, rows = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, raw in enumerate(column_bytes(b.column(2))):
                n, number, tf = counts_in(raw, own.terms)
                if len(number):
                    m = 10 + 90 * n * n_docs // total
                    best.offer(own.scores(number, w[number] * (1_000_000_000 * tf // (1000 * tf + 8 * m))), ids[i], rows[i])
        out = list(zip(*best.rows(), strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array([own.keys[i] for i in out[0]], pa.int64()), *(pa.array(c, pa.int64()) for c in out[1:])],
                                         ["key", "score", "doc_id", "row"])

    return docs.select(F.col("doc_id").cast("bigint"), "row", "text").mapInArrow(tidy(run), "key bigint, score bigint, doc_id bigint, row bigint")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, term_bytes: int = TERM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of ``docs`` (doc_id, text) for each row of
    ``items`` (item_id, text), scores above 0 only, equal scores by ascending doc_id (null last).

    All documents are scanned; null and empty texts have no terms.  Repeated rows of ``docs`` rank each,
    repeated items are answered each; an item without terms or hits has no rows, nor has
    an empty table.  Very long texts are scanned in pieces cut between words; other columns are not read.
    The terms of at most ``term_bytes`` of item text are broadcast at once; more are searched in further scans."""
    checkpoint_dir(docs.sparkSession)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    named = write_table(items.select(F.monotonically_increasing_id().alias("key"), F.col("item_id").alias("item_id"), "text"), "items")
    total = named.agg(F.sum(size)).first()[0] or 0
    blocks = -(-total * 2 // term_bytes) if total > term_bytes else 1
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    best = None
    for block in range(blocks):
        own = named.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block)
        held = Items([(r["key"], t) for r in own.select("key", "text").collect() if (t := terms_of(r["text"]))])  # about term_bytes / 2
        found = write_table(_search(rows, held, k), "scan") if held.keys else None
        best = found if best is None else best if found is None else best.unionByName(found)
    if best is None:
        best = docs.sparkSession.createDataFrame([], "key bigint, score bigint, doc_id bigint, row bigint")
    order = W.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(named.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")
