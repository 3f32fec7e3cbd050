"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are made with XXH64 over word shingles.  Distinct fingerprints that may lie
within ``max_bits`` of each other share at least one of ``max_bits + 1`` bit blocks, so each
is sent once per block to the cell of that block's value; a block value held by very many
fingerprints is dealt again by the blocks of its remaining bits, which is as exact.  A cell
sorts its fingerprints by Gray rank, so that those with equal leading bits are adjacent, and
factors the shared bit patterns into the nodes of a small tree.  The tree is joined with
itself from the top: a pair of nodes carries the differences of the patterns above it and
is dropped with everything below as soon as they pass ``max_bits``.  A cell reports one link
from each fingerprint to the root of its local group, never the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import connected_components
from quarry.llm.memory import tidy
from quarry.session import checkpoint_dir, write_table

SEED = 42
#: Fingerprints a cell holds on average, and those of one block value before it is dealt again.
CELL, HOT = 16384, 2048
#: Pairs of index nodes that are compared at once.
PAIRS = 1 << 20


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of one text as an unsigned int; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [0, *accumulate(len(w) + 1 for w in words)]
    width = min(width, len(words))
    h = np.array([xxhash.xxh64_intdigest(joined[a:b - 1], SEED) for a, b in zip(ends, ends[width:])], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[at:at + (1 << 16)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def simhash(docs: DataFrame, text_col: str = "text", width: int = 3, keep: tuple = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of each row and its fingerprint ``fp`` (bigint, the same 64 bits).

    Null and wordless texts get 0; a text of fewer than ``width`` words is one shingle."""
    checkpoint_dir(docs.sparkSession)
    src = docs.select(*keep, F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(b.num_columns - 1)
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in text), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], [*keep, "fp"])

    schema = src.drop("_text").withColumn("fp", F.lit(0).cast("bigint")).schema
    return src.mapInArrow(tidy(run), schema)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the reflected Gray sequence."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def _pairs(a_at, a_n, b_at, b_n, diff, same) -> Iterator[tuple]:
    """Children pairs of node pairs, at most about PAIRS at once: (a, b, diff so far)."""
    size = a_n * b_n
    for i in np.flatnonzero(size > PAIRS):  # one very large pair: slices of its first side
        step = max(1, PAIRS // int(b_n[i]))
        for at in range(0, int(a_n[i]), step):
            n = min(step, int(a_n[i]) - at)
            a = np.repeat(np.arange(a_at[i] + at, a_at[i] + at + n), b_n[i])
            b = np.tile(np.arange(b_at[i], b_at[i] + b_n[i]), n)
            yield (a, b, np.full(len(a), diff[i]), np.full(len(a), same[i]))
    rest = np.flatnonzero(size <= PAIRS)
    if not len(rest):
        return
    for part in np.split(rest, np.flatnonzero(np.diff(np.cumsum(size[rest]) // PAIRS)) + 1):
        n = size[part]
        owner = np.repeat(part, n)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        yield a_at[owner] + k // b_n[owner], b_at[owner] + k % b_n[owner], diff[owner], same[owner]


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the groups of a[i] and b[i]; labels stay the smallest member's index."""
    while True:
        la, lb = label[a], label[b]
        m = la != lb
        if not m.any():
            return label
        a, b, la, lb = a[m], b[m], la[m], lb[m]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(label, nxt := label[label]):
            label = nxt


class GrayIndex:
    """Tree over distinct 64-bit codes in Gray order; ``cuts`` are the prefix lengths of its levels."""

    def __init__(self, codes: np.ndarray, cuts: tuple[int, ...]):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        codes = codes[self.order]
        self.n, self.levels, above = len(codes), [], 0
        for cut in cuts:
            prefix = codes >> np.uint64(64 - cut)
            start = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]])) if self.n else np.zeros(0, int)
            mask = np.uint64((1 << (cut - above)) - 1)
            self.levels.append((start, prefix[start] & mask))
            above = cut

    def children(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each node of a level: its first child in the next level, and how many."""
        start, nxt = self.levels[level][0], self.levels[level + 1][0]
        first = np.searchsorted(nxt, start)
        return first, np.diff(np.append(first, len(nxt)))

    def links(self, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs of codes with equal first-level patterns and at most max_bits other bits."""
        first, count = self.children(0)
        own = np.flatnonzero(count)
        yield from self._down(0, own, own, np.zeros(len(own), np.int64), np.ones(len(own), bool), max_bits)

    def _down(self, level, a, b, diff, same, max_bits):
        first, count = self.children(level)
        pattern, last = self.levels[level + 1][1], level + 2 == len(self.levels)
        for x, y, d, s in _pairs(first[a], count[a], first[b], count[b], diff, same):
            d = d + np.bitwise_count(pattern[x] ^ pattern[y])
            keep = (d <= max_bits) & (~s | ((x < y) if last else (x <= y)))
            x, y, d, s = x[keep], y[keep], d[keep], s[keep]
            if not len(x):
                continue
            if last:
                yield self.order[self.levels[-1][0][x]], self.order[self.levels[-1][0][y]]
            else:
                yield from self._down(level + 1, x, y, d, s & (x == y), max_bits)


def local_roots(codes: np.ndarray, cuts: tuple[int, ...], max_bits: int) -> np.ndarray:
    """For each code of a cell, the index of the smallest-index member of its linked group."""
    index, label = GrayIndex(codes, cuts), np.arange(len(codes))
    for a, b in index.links(max_bits):
        label = _hook(label, a, b)
    return label


def _bounds(bits: int, parts: int) -> list[int]:
    return [bits * i // parts for i in range(parts + 1)]


def _front(col, at: int, to: int, bits: int):
    """The 64-bit word with its bits [at, to) (counted from the top) moved to the front of the
    first ``bits`` bits; the rest keeps its order."""
    if at == 0:
        return col
    take = F.shiftrightunsigned(F.shiftleft(col, at), 64 - (to - at))
    head = F.shiftrightunsigned(col, 64 - at)
    tail = F.shiftrightunsigned(F.shiftleft(col, to), to) if to < 64 else F.lit(0).cast("bigint")
    return (F.shiftleft(take, 64 - (to - at)).bitwiseOR(F.shiftleft(head, 64 - to)).bitwiseOR(tail))


def fingerprint_links(fps: DataFrame, max_bits: int = 3, cell: int = CELL, hot: int = HOT) -> DataFrame:
    """Distinct fingerprints ``fp`` -> links (a, b) that connect every pair within max_bits
    (at most one link a fingerprint and cell).  Needs 0 <= max_bits <= 15."""
    parts, n = max_bits + 1, fps.count()
    cells = max(1, -(-n // cell))
    edge = _bounds(64, parts)
    first = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("blk"), _front(F.col("fp"), edge[i], edge[i + 1], 64).alias("code"), F.lit(edge[i + 1] - edge[i]).alias("lead"))
        for i in range(parts)])).alias("x")).select("fp", "x.*")
    first = first.withColumn("val", F.expr("shiftrightunsigned(code, 64 - lead)"))
    crowded = write_table(first.groupBy("blk", "val").count().where(F.col("count") > hot).select("blk", "val", F.lit(True).alias("hot")), "crowded")
    first = first.join(crowded, ["blk", "val"], "left")
    plain = first.where("hot IS NULL").select(
        "fp", "code", "lead", F.concat_ws("/", "blk", F.pmod(F.xxhash64("val"), F.lit(cells))).alias("cell"))
    again = []
    for i in range(parts):
        lead = edge[i + 1] - edge[i]
        sub = _bounds(64 - lead, parts)
        rest = F.shiftleft(F.col("code"), lead)
        for j in range(parts):
            wide = sub[j + 1] - sub[j]
            moved = _front(rest, sub[j], sub[j + 1], 64)
            code = F.shiftleft(F.col("val"), 64 - lead).bitwiseOR(F.shiftrightunsigned(moved, lead))
            again.append(F.struct(F.lit(i).alias("blk"), code.alias("code"), F.lit(lead + wide).alias("lead"),
                                  F.concat_ws("/", F.lit(i), F.lit(j), F.pmod(F.xxhash64("val", F.shiftrightunsigned(moved, 64 - wide)), F.lit(cells * 64))).alias("cell")))
    dealt = (first.where("hot").withColumn("x", F.explode(F.array(*again))).where("x.blk = blk")
             .select("fp", "x.code", "x.lead", "x.cell"))

    def links(key: tuple, table: pa.Table) -> pa.Table:
        fp, code = table["fp"].to_numpy(), table["code"].to_numpy().view(np.uint64)
        lead = int(table["lead"][0].as_py())
        step = -(-(64 - lead) // 3)
        cuts = tuple(sorted({lead, min(64, lead + step), min(64, lead + 2 * step), 64}))
        if len(cuts) < 2:
            cuts = (cuts[0], cuts[0])
        root = local_roots(code, cuts, max_bits)
        own = root != np.arange(len(fp))
        return pa.table({"a": fp[own], "b": fp[root[own]]})

    return plain.unionByName(dealt).groupBy("cell").applyInArrow(links, "a bigint, b bigint")


def _components(docs: DataFrame, width: int, max_bits: int, id_col: str, text_col: str, keep: tuple) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints; and of each fingerprint its smallest id ``rep`` and its
    component's ``label``, the smallest linked fingerprint, which is never null."""
    checkpoint_dir(docs.sparkSession)
    fps = write_table(simhash(docs, text_col, width, (id_col, *keep)), "fingerprints")
    nodes = write_table(fps.groupBy("fp").agg(F.min(id_col).alias("rep")), "fingerprint-nodes")
    labels = connected_components(fingerprint_links(nodes.select("fp"), max_bits))
    return fps, nodes.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").select(
        "fp", "rep", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 3, id_col: str = "doc_id",
                    text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """One row per row of ``docs``: id_col, the ``keep`` columns, ``fp`` and ``component_id``,
    the smallest id that links of at most max_bits differing bits reach.

    Wordless and null texts have fingerprint 0 and link like any other.  Null ids count
    after all others (a component of null ids only has a null component_id).  Repeated rows
    stay repeated.  Extra columns of ``docs`` are not read."""
    fps, named = _components(docs, width, max_bits, id_col, text_col, keep)
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    return fps.join(named.join(least, "label").select("fp", "component_id"), "fp").select(id_col, *keep, "fp", "component_id")


def hex_fingerprint(col) -> F.Column:
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def one_of_each(docs: DataFrame, width: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` with only one row of each near-duplicate group: that of the
    smallest doc_id, then of the smallest text hash; rows repeated in full collapse."""
    mark = F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b""))  # of a null text: empty
    fps, named = _components(docs.withColumn("__q_mark", mark), width, max_bits, "doc_id", "text", ("__q_mark",))
    groups = fps.join(named.select("fp", "label"), "fp")
    stay = groups.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("__q_mark").alias("mark"))).alias("s")).select("s.*")
    rows = docs.withColumn("__q_mark", mark).withColumn("__q_id", F.coalesce("doc_id", F.lit(0))).withColumn("__q_no", F.col("doc_id").isNull())
    stay = stay.select(F.coalesce("id", F.lit(0)).alias("__q_id"), F.col("no").alias("__q_no"), F.col("mark").alias("__q_mark"))
    return rows.join(stay, ["__q_id", "__q_no", "__q_mark"], "left_semi").dropDuplicates(["__q_id", "__q_no", "__q_mark"]).select(*docs.columns)
