"""Token files: ids of whole documents in ascending id order, Simple-8b coded.

A file is a Parquet table whose rows are segments of whole documents.  A segment holds its
ids in blocks of ``BLOCK``; a block is a run of 64-bit words, each a 4-bit selector and as
many ids of the selector's width as fit.  Selector 0 is the escape: the next word holds one
value of up to 64 bits.  ``block_offsets`` gives each block's first word, so that blocks
decode on their own and all of a segment's words decode at once, selector by selector.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.tokens import tokenizer
from quarry.session import checkpoint_dir

#: (ids a word, bits an id) by selector, fixed values of the format; selector 0 is the escape.
LAYOUT = ((1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10),
          (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK, SEGMENT = 1024, 1 << 18


def simple8b_encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values (unsigned) -> (words uint64, first word of each block of BLOCK values uint32)."""
    v = values.astype(np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    at = np.arange(n)
    stop = np.minimum((at // BLOCK + 1) * BLOCK, n)
    pick = np.zeros(n, np.uint8)
    open_ = np.ones(n, bool)
    top = v.max()
    for s, (count, bits) in enumerate(LAYOUT[1:], 1):
        if bits < 60 and top >> np.uint64(bits) == 0:
            fits = np.ones(n, bool)
        else:
            over = np.where(v >> np.uint64(bits) != 0, at, n)
            nxt = np.minimum.accumulate(over[::-1])[::-1]
            fits = nxt >= np.minimum(at + count, stop)
        pick[open_ & fits] = s
        open_ &= ~fits
        if not open_.any():
            break
    count = np.array([c for c, _ in LAYOUT])
    starts, words_of = [], []
    p = np.arange(0, n, BLOCK)
    block = np.arange(len(p))
    while len(p):  # one word of every block that is not done
        starts.append(p)
        words_of.append(block)
        p = p + count[pick[p]]
        left = p < np.minimum((block + 1) * BLOCK, n)
        p, block = p[left], block[left]
    start, block = np.concatenate(starts), np.concatenate(words_of)
    order = np.argsort(start, kind="stable")
    start, block = start[order], block[order]
    sel = pick[start].astype(np.int64)
    size = np.where(sel == 0, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    words[place] = sel.astype(np.uint64) << np.uint64(60)
    words[place[sel == 0] + 1] = v[start[sel == 0]]
    for s, (c, bits) in enumerate(LAYOUT[1:], 1):
        own = np.flatnonzero(sel == s)
        if len(own):
            end = stop[start[own]]
            for k in range(c):
                here = start[own] + k
                m = here < end
                words[place[own[m]]] |= v[here[m]] << np.uint64(bits * k)
    return words, place[np.searchsorted(block, np.arange(-(-n // BLOCK)))].astype(np.uint32)


def simple8b_decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values of a segment, all words at once."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    sel = (words >> np.uint64(60)).astype(np.int64)
    # A word after an escape is data.  Escapes are rare: walk them only.
    head = np.ones(len(words), bool)
    data_until = -1
    for i in np.flatnonzero(sel == 0):
        if i > data_until:
            head[i + 1] = False
            data_until = i + 1
    place = np.flatnonzero(head)
    sel = sel[place]
    count = np.array([c for c, _ in LAYOUT])[sel]
    block = np.searchsorted(offsets, place, "right") - 1
    before = np.cumsum(count) - count
    first = before[np.searchsorted(place, offsets)]
    start = block * BLOCK + before - first[block]
    stop = np.minimum((block + 1) * BLOCK, n)
    for s, (c, bits) in enumerate(LAYOUT):
        own = np.flatnonzero(sel == s)
        if not len(own):
            continue
        if s == 0:
            out[start[own]] = words[place[own] + 1]
            continue
        mask = np.uint64((1 << bits) - 1)
        for k in range(c):
            here = start[own] + k
            m = here < stop[own]
            out[here[m]] = words[place[own[m]]] >> np.uint64(bits * k) & mask
    return out


SEGMENTS = ("part int, seq int, doc_ids array<bigint>, lens array<int>, n_ids bigint, "
            "words binary, block_offsets binary")


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id",
                      text_col: str = "text") -> None:
    """Write the ids of every row's whole text, ``end_id`` after each, in ascending id order.

    Null text is empty (the end id alone); null ids come first; repeated ids lie side by side,
    in order of their text's hash; an empty table writes an empty table.  Other columns are
    not read."""
    checkpoint_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids, lens, held, tok = [], [], [], tokenizer(vocabulary)

        def segment():
            every = np.concatenate(held)
            words, offsets = simple8b_encode(every)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([lens], pa.list_(pa.int32())), pa.array([len(every)], pa.int64()),
                 pa.array([words.tobytes()]), pa.array([offsets.tobytes()])],
                ["part", "seq", "doc_ids", "lens", "n_ids", "words", "block_offsets"])

        size, end = 0, np.array([end_id], np.uint32)
        for b in batches:
            for doc, own in zip(b.column(0).to_pylist(), tok.encode(b.column(1)), strict=True):
                if held and size + len(own) + 1 > SEGMENT:
                    yield segment()
                    seq, size, ids, lens, held = seq + 1, 0, [], [], []
                ids.append(doc)
                lens.append(len(own) + 1)
                held += [own, end]
                size += len(own) + 1
        if held:
            yield segment()

    rows.mapInArrow(encode, SEGMENTS).write.parquet(path)


def _decode(words: bytes, offsets: bytes, n: int) -> np.ndarray:
    return simple8b_decode(np.frombuffer(words, np.uint64), np.frombuffer(offsets, np.uint32), n).astype(np.uint32)


def _with_start(spark: SparkSession, path: str, out: DataFrame) -> DataFrame:
    """Adds the ids before each row's segment: sums of the segments' sizes, by part, then within."""
    sizes = spark.read.parquet(path).select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("s"))
    parts = parts.select("part", F.coalesce(F.sum("s").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    run = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = sizes.withColumn("run", run).join(parts, "part").select("part", "seq", (F.col("run") + F.col("base")).alias("base"))
    return out.join(base, ["part", "seq"]).withColumn("start", F.col("base") + F.col("start")).drop("part", "seq", "base")


def read_token_files(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """One row a document from the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and, if asked for, ids."""
    checkpoint_dir(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r].as_py() for c in b.schema.names}
                every = _decode(row["words"], row["block_offsets"], row["n_ids"])
                n = np.array(row["lens"], np.int64)
                end = np.cumsum(n)
                own = np.split(every, end[:-1])
                cols = [pa.array(np.full(len(n), row["part"], np.int32)), pa.array(np.full(len(n), row["seq"], np.int32)),
                        pa.array(row["doc_ids"], pa.int64()), pa.array(end - n), pa.array(n),
                        pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                names = ["part", "seq", "doc_id", "start", "n_tokens", "ids_crc32"]
                if ids:
                    cols.append(pa.ListArray.from_arrays(np.append(0, end).astype(np.int32), every.astype(np.int32)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "part int, seq int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if ids else "")
    return _with_start(spark, path, spark.read.schema(SEGMENTS).parquet(path).mapInArrow(decode, schema))
