"""Web-search queries against chunks, a unit of chunks at a time (OP-R5..R7, OP-T2, OP-W2).

A chunk is one row with its tokens, so all that a query asks of it stands in that row: no postings are
exploded, joined or shuffled, only answers leave a task.  The parsed queries are broadcast; a task takes its
chunks in units of bounded size, keeps the places of query words (sorted by word, chunk and position) and
answers every query from these lists with a few numpy searches.  Queries of one meaning are answered once.

For the first ``k`` chunks of a query a unit is cut into blocks.  A block can only match an OR group if it holds
all its lexemes.  A chunk has no more covers than hit positions less all but one of a group's lexemes, and no
cover scores more than the weight of one, so the largest counts in a chunk bound a block's best score.
A query first reads its most promising blocks, until they hold about twice the results it wants; of
the others only those whose bound exceeds the k-th score found, or equals it with smaller keys.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import is_stop_word, s_stem
from quarry.operators.vector_search import _arrow_type, _first_k
from quarry.session import checkpoint_dir

# Fixed value: weight of unlabelled text in cover-density ranking.
DEFAULT_WEIGHT = 0.1
#: Most tokens and chunks of a unit (a row more), chunks of a block of a unit, and rows of an Arrow batch given back.
UNIT_TOKENS, UNIT_CHUNKS, BLOCK_CHUNKS, OUT_ROWS = 1 << 21, 1 << 16, 512, 1 << 15


@dataclass(frozen=True)
class Queries:
    """Parsed queries of one meaning each: OR groups of (held items, absent items), an item (offset, lexeme number)s."""
    variants: list[str]  # every token whose lexeme a query names
    lexeme: np.ndarray  # of each variant
    n_lexemes: int
    shapes: list[tuple]


def parsed(terms: DataFrame, query_id: str) -> tuple[Queries, DataFrame]:
    """(queries, (query, shape)) from term rows, which the caller has found to fit a broadcast."""
    spark = terms.sparkSession
    rows = terms.where(F.col(query_id).isNotNull()).select(query_id, "group_id", "item_id", "negated", "term_offset", "lexeme").toArrow()
    lexemes = rows.column("lexeme").unique().to_pylist()
    number = {x: i for i, x in enumerate(lexemes)}
    found: dict = {}
    for q, g, i, neg, at, x in zip(*(c.to_pylist() for c in rows.columns), strict=True):
        found.setdefault(q, {}).setdefault(g, {}).setdefault((i, neg), []).append((at, number[x]))
    shapes: dict = {}
    of = []
    for q, groups in found.items():
        every = set()
        for items in groups.values():
            sides: tuple[set, set] = set(), set()
            for (_, neg), places in items.items():
                least = min(at for at, _ in places)
                sides[bool(neg)].add(tuple(sorted((at - least, x) for at, x in places)))
            every.add((tuple(sorted(sides[0])), tuple(sorted(sides[1]))))
        of.append((q, shapes.setdefault(tuple(sorted(every)), len(shapes))))
    # The stemmer takes off a final s or turns ies into y: three tokens can have a lexeme.
    x = spark.createDataFrame([(i, w) for i, w in enumerate(lexemes)], "i int, w string")
    forms = F.array("w", F.concat("w", F.lit("s")), F.concat(F.expr("left(w, length(w) - 1)"), F.lit("ies")))
    tokens = x.select("i", "w", F.explode(F.array_distinct(forms)).alias("t")).where((s_stem("t") == F.col("w")) & ~is_stop_word("t")).collect()
    schema = T.StructType([terms.schema[query_id], T.StructField("_shape", T.IntegerType())])
    queries = Queries([r["t"] for r in tokens], np.array([r["i"] for r in tokens], np.int32), len(lexemes), list(shapes))
    return queries, spark.createDataFrame(of, schema)


def _inside(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of ``a`` are in ``b`` (sorted)."""
    if not len(b):
        return np.zeros(len(a), bool)
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


class Unit:
    """The places of query words in some chunks; chunks are numbered in order of key, a place is chunk << 32 | position."""

    def __init__(self, place: np.ndarray, lexeme: np.ndarray, n_lexemes: int, block: np.ndarray):
        order = np.lexsort((place, lexeme))
        self.place, lexeme = place[order], lexeme[order]
        self.edge = np.searchsorted(lexeme, np.arange(n_lexemes + 1))
        chunk = self.place >> 32
        first = np.flatnonzero(np.r_[True, (lexeme[1:] != lexeme[:-1]) | (chunk[1:] != chunk[:-1])]) if len(chunk) else np.zeros(0, np.int64)
        self.chunk, tf = chunk[first], np.diff(np.r_[first, len(chunk)])
        self.chunk_edge = np.searchsorted(lexeme[first], np.arange(n_lexemes + 1))
        self.block, self.n_blocks, self.n = block, int(block[-1]) + 1 if len(block) else 0, len(block)
        lex, at = lexeme[first], block[self.chunk]
        head = np.flatnonzero(np.r_[True, (lex[1:] != lex[:-1]) | (at[1:] != at[:-1])]) if len(lex) else np.zeros(0, np.int64)
        self.head_block, self.head_chunks = at[head], np.diff(np.r_[head, len(lex)])
        self.head_tf = np.maximum.reduceat(tf, head) if len(head) else np.zeros(0, np.int64)
        self.head_edge = np.searchsorted(lex[head], np.arange(n_lexemes + 1))

    def places(self, x: int) -> np.ndarray:
        return self.place[self.edge[x]:self.edge[x + 1]]

    def holding(self, item: tuple, among: np.ndarray | None = None) -> np.ndarray:
        """Chunks with an item, in order: a word, or a phrase whose words stand at their offsets."""
        if len(item) == 1:
            x = item[0][1]
            rows = self.chunk[self.chunk_edge[x]:self.chunk_edge[x + 1]]
            return rows if among is None else among[_inside(among, rows)]
        by_count = sorted(item, key=lambda t: self.edge[t[1] + 1] - self.edge[t[1]])
        anchor = self.places(by_count[0][1]) - by_count[0][0]
        for at, x in by_count[1:]:
            anchor = anchor[_inside(anchor + at, self.places(x))]
        rows = np.unique((anchor + by_count[0][0]) >> 32)
        return rows if among is None else among[_inside(among, rows)]

    def matching(self, shape: tuple, by_absence: bool, blocks: np.ndarray | None = None) -> np.ndarray:
        """Chunks that satisfy a query, in order; of the blocks marked only."""
        found = []
        for held, absent in shape:
            if held:
                counts = [min(self.chunk_edge[x + 1] - self.chunk_edge[x] for _, x in item) for item in held]
                rows = None
                for i in np.argsort(counts, kind="stable"):
                    if rows is None:
                        rows = self.holding(held[i])
                        rows = rows if blocks is None else rows[blocks[self.block[rows]]]
                    elif len(rows):
                        rows = self.holding(held[i], rows)
            elif by_absence:
                rows = np.arange(self.n)
            else:
                continue
            for item in absent:
                if len(rows):
                    rows = rows[~_inside(rows, self.holding(item))]
            found.append(rows)
        if not found:
            return np.zeros(0, np.int64)
        return found[0] if len(found) == 1 else np.unique(np.concatenate(found))

    def covers(self, shape: tuple, rows: np.ndarray) -> np.ndarray:
        """Cover-density scores of ``rows`` (in order): for every hit position r, left(r) is the largest over OR groups of the
        least over the group's lexemes of their latest position up to r; covers are (left, r) for the first r of each left."""
        groups = [{x for item in held for _, x in item} for held, _ in shape if held]
        hits = {}
        for x in set().union(*groups):
            p = self.places(x)
            low, high = np.searchsorted(p, rows << 32), np.searchsorted(p, (rows + 1) << 32)
            n = high - low
            hits[x] = p[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        if not hits:
            return np.zeros(len(rows))
        every = next(iter(hits.values())) if len(hits) == 1 else np.unique(np.concatenate(list(hits.values())))
        begin = every >> 32 << 32
        left = np.full(len(every), -1)
        for g in groups:
            least = None
            for x in g:
                p = np.r_[-1, hits[x]]
                latest = p[np.searchsorted(p, every, side="right") - 1]
                latest = np.where(latest < begin, -1, latest)
                least = latest if least is None else np.minimum(least, latest)
            left = np.maximum(left, least)
        end = np.flatnonzero(left >= 0)
        new = left[end]
        end = end[np.r_[True, new[1:] != new[:-1]]] if len(end) else end
        noise = (every[end] - left[end]) - (end - np.searchsorted(every, left[end]))
        score = np.bincount(np.searchsorted(rows, every[end] >> 32), weights=DEFAULT_WEIGHT / (1.0 + noise), minlength=len(rows))
        return score.astype(np.float32).astype(np.float64)

    def bounds(self, shape: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(blocks that hold all lexemes of a group, bound on the score of their chunks, no fewer than those that match)."""
        chunks, tf = {}, {}
        groups = [{x for item in held for _, x in item} for held, _ in shape if held]
        for x in set().union(*groups):
            a, b = self.head_edge[x], self.head_edge[x + 1]
            chunks[x], tf[x] = np.zeros(self.n_blocks, np.int64), np.zeros(self.n_blocks, np.int64)
            chunks[x][self.head_block[a:b]], tf[x][self.head_block[a:b]] = self.head_chunks[a:b], self.head_tf[a:b]
        few, words = np.zeros(self.n_blocks, np.int64), np.full(self.n_blocks, 1 << 40)
        rare = words.copy()
        for g in groups:
            least = np.minimum.reduce([chunks[x] for x in g])
            few += least
            words = np.where(least > 0, np.minimum(words, len(g)), words)
            rare = np.where(least > 0, np.minimum(rare, np.minimum.reduce([tf[x] for x in g])), rare)
        held = np.flatnonzero(few)
        covers = sum(tf.values())[held] - words[held] + 1
        if len(groups) == 1 and len(groups[0]) == 2:  # each occurrence of the rarer one is in a cover with the nearest other on either side only
            covers = np.minimum(covers, 2 * rare[held])
        # Scores are single precision sums; the small factor covers their rounding.
        return held, (DEFAULT_WEIGHT * covers * (1 + 1e-9)).astype(np.float32).astype(np.float64), few[held]

    def first(self, shape: tuple, k: int, least: float, by_absence: bool) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(chunks, scores, blocks that could match, blocks read) of a query's first ``k``; scores under ``least`` may be left out."""
        if any(not held for held, _ in shape):
            if not by_absence:
                shape = tuple(g for g in shape if g[0])
            else:  # matched by absence, which no count tells
                rows = self.matching(shape, True)
                if not any(held for held, _ in shape):
                    return rows[:k], np.zeros(len(rows[:k])), 0, 0
                scores = self.covers(shape, rows)
                best = _best(rows, scores, k)
                return rows[best], scores[best], 0, 0
        held, bound, few = self.bounds(shape) if shape else (np.zeros(0, np.int64),) * 3
        order = np.argsort(-bound, kind="stable")
        early = np.zeros(len(held), bool)
        early[order] = (np.cumsum(few[order]) - few[order] < 2 * k) & (bound[order] >= least)
        rows, scores = self._read(shape, held[early], k)
        late = ~early & (bound >= least)
        if len(rows) == k:
            late &= (bound > scores[-1]) | ((bound == scores[-1]) & (held < self.block[rows[-1]]))
        if late.any():
            more, more_scores = self._read(shape, held[late], k)
            rows, scores = np.r_[rows, more], np.r_[scores, more_scores]
            best = _best(rows, scores, k)
            rows, scores = rows[best], scores[best]
        return rows, scores, len(held), int(early.sum() + late.sum())

    def _read(self, shape: tuple, blocks: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(blocks):
            return np.zeros(0, np.int64), np.zeros(0)
        marked = np.zeros(self.n_blocks, bool)
        marked[blocks] = True
        rows = self.matching(shape, False, None if len(blocks) == self.n_blocks else marked)
        scores = self.covers(shape, rows)
        best = _best(rows, scores, k)
        return rows[best], scores[best]


def _best(rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first ``k`` by falling score, equal scores by chunk."""
    if len(rows) <= k:
        return np.lexsort((rows, -scores))
    use = np.flatnonzero(scores >= -np.partition(-scores, k - 1)[k - 1])
    return use[np.lexsort((rows[use], -scores[use]))][:k]


def _units(batches: Iterator[pa.RecordBatch], queries: Queries, keys: list[str], block_col: str | None) -> Iterator[tuple[Unit, pa.Table]]:
    """Units of chunks and their keys, both in order of key."""
    vocabulary = pa.array(queries.variants, pa.string())
    held: list[tuple] = []
    n_tokens = n_rows = 0

    def unit() -> tuple[Unit, pa.Table]:
        table = pa.Table.from_batches([h[0] for h in held])
        order = pc.sort_indices(table, [(c, "ascending") for c in keys]).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place = np.concatenate([(rank[h[1]] << 32) | h[2] for h in held])
        table = table.take(pa.array(order))
        if block_col is None:
            block = np.arange(len(order)) // BLOCK_CHUNKS
        else:
            block = table.column(block_col).to_numpy()
            block = np.cumsum(np.r_[False, block[1:] != block[:-1]])
        return Unit(place, np.concatenate([h[3] for h in held]), queries.n_lexemes, block), table.select(keys)

    for b in batches:
        # A row beyond the bound ends a unit, so a batch of long chunks is taken in pieces.
        lengths = pc.fill_null(pc.list_value_length(b.column("tokens")), 0).to_numpy(zero_copy_only=False)
        piece = (np.cumsum(lengths) - lengths) // UNIT_TOKENS
        edges = np.r_[0, np.flatnonzero(np.diff(piece)) + 1, len(piece)] if len(piece) else np.zeros(0, np.int64)
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            part, n = b.slice(i, j - i), lengths[i:j]
            at = pc.fill_null(pc.index_in(pc.list_flatten(part.column("tokens")), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
            use = np.flatnonzero(at >= 0)
            row = np.searchsorted(np.cumsum(n), use, side="right")
            held.append((part.drop_columns(["tokens"]), row + n_rows, use - (np.cumsum(n) - n)[row] + 1, queries.lexeme[at[use]]))
            n_rows += j - i
            n_tokens += int(n.sum())
            if n_tokens >= UNIT_TOKENS or n_rows >= UNIT_CHUNKS:
                yield unit()
                held.clear()
                n_tokens = n_rows = 0
    if held:
        yield unit()


def scan(rows: DataFrame, queries: Queries, key_cols: Sequence[str], k: int | None = None, by_absence: bool = False,
         block_col: str | None = None) -> DataFrame:
    """(_shape, keys, lexical_score, possible, read): with ``k`` no fewer than the first ``k`` matching chunks of each query, and a
    row a query and task without score of the blocks that could match and those read; else every match.

    ``rows``: keys (together unique and not null), tokens, and if named the block; a block is a range of keys."""
    checkpoint_dir(rows.sparkSession)
    keys = list(key_cols)
    bc = rows.sparkSession.sparkContext.broadcast(queries)
    fields = [T.StructField("_shape", T.IntegerType()), *[T.StructField(c, rows.schema[c].dataType) for c in keys], T.StructField("lexical_score", T.DoubleType()),
              T.StructField("possible", T.LongType()), T.StructField("read", T.LongType())]
    schema = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in fields])

    def out(shape: np.ndarray, at: np.ndarray, score: np.ndarray, table: pa.Table) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(shape), OUT_ROWS):
            own = table.take(pa.array(at[i:i + OUT_ROWS]))
            n = own.num_rows
            cols = [pa.array(shape[i:i + OUT_ROWS], pa.int32()), *own.columns, pa.array(score[i:i + OUT_ROWS]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
            yield from pa.Table.from_arrays(cols, schema=schema).to_batches()

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = bc.value
        for unit, table in _units(batches, q, keys, block_col):
            shape, at, score, n = [], [], [], 0
            for s, groups in enumerate(q.shapes):
                found = unit.matching(groups, by_absence)
                if not len(found):
                    continue
                shape.append(np.full(len(found), s, np.int32))
                at.append(found)
                score.append(unit.covers(groups, found))
                n += len(found)
                if n >= OUT_ROWS:
                    yield from out(np.concatenate(shape), np.concatenate(at), np.concatenate(score), table)
                    shape, at, score, n = [], [], [], 0
            if n:
                yield from out(np.concatenate(shape), np.concatenate(at), np.concatenate(score), table)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = bc.value
        least = np.full(len(q.shapes), -np.inf)
        work = np.zeros((2, len(q.shapes)), np.int64)
        shape, score, best = np.zeros(0, np.int32), np.zeros(0), None  # so far; row i of ``best`` has the keys of the i-th
        for unit, table in _units(batches, q, keys, block_col):
            found = []
            for s, groups in enumerate(q.shapes):
                at, own, possible, read = unit.first(groups, k, least[s], by_absence)
                work[:, s] += possible, read
                if len(at):
                    found.append((np.full(len(at), s, np.int32), at, own))
            if not found:
                continue
            s, at, own = (np.concatenate(x) for x in zip(*found, strict=True))
            table = table.take(pa.array(at))
            shape, score, best = np.r_[shape, s], np.r_[score, own], table if best is None else pa.concat_tables([best, table])
            place = np.empty(len(shape), np.int64)
            place[pc.sort_indices(best, [(c, "ascending") for c in keys]).to_numpy()] = np.arange(len(shape))
            keep = _first_k(shape, score, place, k)
            shape, score, best = shape[keep], score[keep], best.take(pa.array(keep))
            kth = np.flatnonzero(shape[k - 1:] == shape[:max(0, len(shape) - k + 1)]) + k - 1
            least[shape[kth]] = score[kth]
        if best is not None:
            yield from out(shape, np.arange(len(shape)), score, best)
        s = np.flatnonzero(work[0])
        none = [pa.nulls(len(s), f.type) for f in list(schema)[1:-2]]
        yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), *none, pa.array(work[0][s]), pa.array(work[1][s])], schema=schema)

    columns = [*keys, *([block_col] if block_col else []), "tokens"]
    return rows.select(*columns).mapInArrow(matches if k is None else first, T.StructType(fields))
