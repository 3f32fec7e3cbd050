"""Packing documents into token windows by non-negative least squares on the length histogram.

A document is cut into full windows, a main piece (a multiple of ``unit`` tokens) and a tail
shorter than ``unit``.  Combinations of at most ``depth`` main lengths that fill a window are
enumerated; non-negative least squares fits how often each is used to the histogram of
lengths; the counts are rounded down so that no length is overdrawn, and what is left, tails
included, is packed greedily, longest first, again as repeated patterns over the histogram.
Only the histogram reaches the driver.  A piece's place follows from its rank among the
pieces of its length, which Spark counts in two levels.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.memory import tidy
from quarry.llm.tokens import tokenizer
from quarry.session import checkpoint_dir, write_table

WINDOW, UNIT, DEPTH = 4096, 64, 3
#: Pieces of one length that are ranked in one task, on average.
RANK_ROWS = 5_000


def cut_points(n: int, window: int = WINDOW, unit: int = UNIT) -> list[int]:
    """Ends of the pieces of a document of n tokens."""
    ends = list(range(window, n + 1, window))
    rest = n % window
    if rest >= unit and rest % unit:
        ends.append(n - rest % unit)
    if rest:
        ends.append(n)
    return ends


def document_pieces(docs: DataFrame, vocabulary: str, end_id: int = 2, window: int = WINDOW, unit: int = UNIT,
                    id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """id_col, start, length, ids_crc32, doc_tokens (and ids) of each piece of each row's text."""
    checkpoint_dir(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(vocabulary), np.array([end_id], np.uint32)
        for b in batches:
            doc, start, length, crc, total, held = [], [], [], [], [], []
            for key, own in zip(b.column(0).to_pylist(), tok.encode(b.column(1)), strict=True):
                own = np.concatenate([own, end])
                at = 0
                for to in cut_points(len(own), window, unit):
                    doc.append(key)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(own[at:to].tobytes()))
                    total.append(len(own))
                    if ids:
                        held.append(own[at:to])
                    at = to
            cols = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
            if ids:
                cols.append(pa.array(held, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{id_col}` bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + (", ids array<int>" if ids else "")
    return src.mapInArrow(tidy(run), schema)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """min |a x - b| over x >= 0 by the active-set method of Lawson and Hanson."""
    x, inside = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, np.abs(a.T @ b).max(initial=0.0))
    for _ in range(rounds or 3 * a.shape[1]):
        w = a.T @ (b - a @ x)
        w[inside] = -np.inf
        if w.max(initial=-np.inf) <= tol:
            break
        inside[int(w.argmax())] = True
        while True:
            z = np.zeros_like(x)
            z[inside] = np.linalg.lstsq(a[:, inside], b, rcond=None)[0]
            low = inside & (z <= 0)
            if not low.any():
                break
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = np.maximum(x + step * (z - x), 0)
            inside &= ~(low & (x <= 1e-12))
            x[~inside] = 0
        x = z
    return x


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """Non-increasing lengths (in units) that add up to ``units``, at most ``depth`` of them."""
    def grow(left: int, most: int, room: int):
        if not left:
            yield ()
        elif room:
            for k in range(min(left, most), 0, -1):
                yield from ((k, *rest) for rest in grow(left - k, k, room - 1))
    return list(grow(units, units, depth))


def plan(histogram: dict[int, int], window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> list[tuple[int, dict[int, int]]]:
    """Patterns (how many sequences, {length: pieces a sequence}) that use up the histogram."""
    left, out = {k: v for k, v in histogram.items() if v}, []

    def use(times: int, need: dict[int, int]) -> None:
        out.append((times, need))
        for k, n in need.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]

    units = window // unit
    present = [c for c in combinations(units, depth) if all(left.get(k * unit) for k in c)]
    if present:
        lengths = sorted({k for c in present for k in c})
        row = {k: i for i, k in enumerate(lengths)}
        a = np.zeros((len(lengths), len(present)))
        for j, c in enumerate(present):
            for k in c:
                a[row[k], j] += 1
        times = nnls(a, np.array([left[k * unit] for k in lengths], float))
        for j in np.argsort(-times, kind="stable"):
            need = {k * unit: present[j].count(k) for k in present[j]}
            n = min(int(times[j] + 1e-6), *(left.get(k, 0) // m for k, m in need.items()))
            if n:
                use(n, need)
    while left:
        need, room = {}, window
        for k in sorted(left, reverse=True):
            if n := min(left[k], room // k):
                need[k], room = n, room - n * k
        use(min(left[k] // n for k, n in need.items()), need)
    return out


def slots(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, pieces a sequence, offset of the first)."""
    taken, table, sequence = {}, {}, 0
    for times, need in patterns:
        offset = 0
        for k in sorted(need, reverse=True):
            rank = taken.get(k, 0)
            table.setdefault(k, []).append((rank, sequence, need[k], offset))
            taken[k] = rank + need[k] * times
            offset += need[k] * k
        sequence += times
    return {k: np.array(v, np.int64) for k, v in table.items()}


def pack(pieces: DataFrame, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH, rank_rows: int = RANK_ROWS) -> DataFrame:
    """Adds sequence_id and offset to pieces (a written table with ``length`` at most ``window``)."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most window rows
    ranges = max(1, -(-max(counts.values(), default=0) // rank_rows))
    table = slots(plan(counts, window, unit, depth))
    key = F.xxhash64(*[c for c in pieces.columns if c != "ids"])
    p = pieces.withColumn("_key", key).withColumn("_part", F.pmod(F.col("_key"), F.lit(ranges)))
    sums = p.groupBy("length", "_part").count()
    base = sums.select("length", "_part", F.coalesce(F.sum("count").over(W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    p = p.withColumn("_n", F.row_number().over(W.partitionBy("length", "_part").orderBy("_key", "start")))
    p = p.join(base, ["length", "_part"]).withColumn("_rank", F.col("_base") + F.col("_n") - 1).select(*pieces.columns, "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                own, rows = np.flatnonzero(length == k), table[int(k)]
                row = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
                nth = rank[own] - row[:, 0]
                sequence[own], offset[own] = row[:, 1] + nth // row[:, 2], row[:, 3] + nth % row[:, 2] * k
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], [*b.schema.names[:-1], "sequence_id", "offset"])

    schema = pieces.withColumn("sequence_id", F.lit(0).cast("bigint")).withColumn("offset", F.lit(0).cast("bigint")).schema
    return p.mapInArrow(tidy(place), schema)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, window: int = WINDOW, unit: int = UNIT,
                   depth: int = DEPTH, ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Every row of ``docs`` is packed, repeated rows each time; null text is the end id alone; a
    null doc_id stays null; an empty table gives an empty result.  Other columns are not read."""
    return pack(write_table(document_pieces(docs, vocabulary, end_id, window, unit, ids=ids), "pieces"), window, unit, depth)
