"""Target-distribution importance resampling of documents.

Runs of words are hashed into an array of buckets, counted over all documents and over a target
collection.  A document's weight is the mean log gain of its buckets, read from the array; with
Gumbel noise from a hash of its id added, the highest scores are a draw without replacement in
proportion to the weights.  The order comes from a distributed LSD radix sort: for each digit of
the composite key (score, then id), least first, rows are counted by range of positions and digit,
prefix sums over (digit, range) give where every group begins, and a row's new position is that
offset plus its place within the group.  No range or digit is ever gathered whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.bytewords import GAP, column_bytes, word_spans, word_table
from quarry.llm.memory import tidy
from quarry.session import checkpoint_dir, write_table

BUCKETS, LONGEST_RUN = 10_000, 2
#: Bytes of text hashed at once; words beyond LONG bytes are hashed one by one.
CHUNK, LONG = 1 << 20, 48
#: Bits of a digit, and of the positions that make a range: a group has at most 2**RANGE_BITS rows.
DIGIT_BITS, RANGE_BITS = 10, 14
WORDS = word_table(b"0123456789abcdefghijklmnopqrstuvwxyz")


def _crc_steps() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


STEP = _crc_steps()
ALL = np.uint32(0xFFFFFFFF)


def _extend(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC states carried on over data[start:end], a byte of all words at a time."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    order = order[np.searchsorted(-length[order], -LONG):]  # at most LONG bytes
    s, at = state[order], start[order]
    longer = np.searchsorted(-length[order], -np.arange(1, LONG + 1), side="right")
    for k in range(LONG):
        n = longer[k]
        if not n:
            break
        s[:n] = STEP[(s[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (s[:n] >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = s
    for i in np.flatnonzero(length > LONG):
        out[i] = np.uint32(zlib.crc32(data[start[i]:end[i]], int(state[i] ^ ALL))) ^ ALL
    return out


def _pieces(texts: list[bytes], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]]:
    """Normalised texts in pieces of about CHUNK bytes: (bytes, word starts, word ends, words carried from
    the piece before, index of each word's text).  Only a text beyond CHUNK bytes is cut, between words."""
    held, size, first = [], 0, 0

    def piece(parts: list[bytes], first: int, carried: int):
        raw = GAP.join(parts)
        data = np.frombuffer(raw, np.uint8)
        start, end = word_spans(data)
        edge = np.cumsum([len(p) + 1 for p in parts])
        return data, start, end, carried, first + np.searchsorted(edge, start, side="right")

    for i, raw in enumerate(texts):
        raw = raw.translate(WORDS)
        if held and size + len(raw) > CHUNK:
            yield piece(held, first, 0)
            held, size = [], 0
        if len(raw) <= CHUNK:
            if not held:
                first = i
            held.append(raw)
            size += len(raw) + 1
            continue
        tail, at = [], 0
        while at < len(raw):
            cut = raw.find(GAP, at + CHUNK)
            cut = len(raw) if cut < 0 else cut
            data, start, end, _, text = piece([GAP.join([*tail, raw[at:cut]])], i, 0)
            yield data, start, end, len(tail), text
            tail = [data[a:b].tobytes() for a, b in zip(start[max(0, len(start) - longest + 1):], end[max(0, len(end) - longest + 1):], strict=True)] if longest > 1 else []
            at = cut
    if held:
        yield piece(held, first, 0)


def features(texts: list[bytes], buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket of each run of 1 to ``longest`` words, index of its text, index of the text of each new word)."""
    for data, start, end, carried, text in _pieces(texts, longest):
        if not len(start):
            continue
        state = np.full(len(start), ALL)
        found, of = [], []
        for n in range(1, longest + 1):  # state[i]: the run of n words from word i
            k = len(start) - n + 1
            if k <= 0:
                break
            if n > 1:
                state = STEP[(state[:k] ^ np.uint32(32)) & np.uint32(255)] ^ (state[:k] >> np.uint32(8))
            state = _extend(state[:k], data, start[n - 1:], end[n - 1:])
            use = np.flatnonzero((text[:k] == text[n - 1:]) & (np.arange(n - 1, n - 1 + k) >= carried))
            found.append((state[use] ^ ALL) % np.uint32(buckets))
            of.append(text[use])
        yield np.concatenate(found), np.concatenate(of), text[carried:]


def bucket_counts(texts: Column, rows: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """(bucket, n): features of all texts by bucket.  Each task sends one sum a bucket."""
    checkpoint_dir(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for bucket, _, _ in features(list(column_bytes(b.column(0))), buckets, longest):
                n += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held])], ["bucket", "n"])

    return rows.select(texts).mapInArrow(tidy(count), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln ratio) of every bucket from counts (bucket, n): an array of ``buckets`` whole numbers."""
    sides = []
    for counts in (source, target):
        n = [0] * buckets
        for r in counts.collect():  # at most ``buckets`` rows
            n[r["bucket"]] = r["n"]
        sides.append(n)
    s, t = sides
    all_s, all_t = sum(s), sum(t)
    return np.array([math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)], np.int64)


def weigh(rows: DataFrame, text_col: str, gain: np.ndarray, longest: int = LONGEST_RUN) -> DataFrame:
    """The other columns of ``rows`` with n_words, n_features and weight (floored mean gain) of each text."""
    checkpoint_dir(rows.sparkSession)
    keep = [c for c in rows.columns if c != text_col]
    src = rows.select(*keep, text_col)
    held = rows.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for b in batches:
            total, n, words = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for bucket, of, new in features(list(column_bytes(b.column(len(keep)))), len(gain), longest):
                np.add.at(total, of, gain[bucket])
                n += np.bincount(of, minlength=b.num_rows)
                words += np.bincount(new, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))],
                                             [*keep, "n_words", "n_features", "weight"])

    schema = src.select(*keep, *[F.lit(0).cast("bigint").alias(c) for c in ("n_words", "n_features", "weight")]).schema
    return src.mapInArrow(tidy(run), schema)


def gumbel(id_col: str, seed: int | str = 7) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of sha256 of ``seed:id``; a null id counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def radix_rank(rows: DataFrame, keys: list[str], digit_bits: int = DIGIT_BITS, range_bits: int = RANGE_BITS) -> DataFrame:
    """(row, rank): rank from 1 in ascending order of ``keys``, the first weighing most.

    ``row`` names each row; keys are 64-bit patterns compared without sign.  Rows with equal keys
    are ranked one after the other in the order they are read.  Digits in which all keys agree need no
    pass.  A group of one range and one digit has at most 2**range_bits rows, and the offsets
    of a digit one row a range, so equal keys do not gather."""
    at = write_table(rows.select("row", *keys).withColumn("at", F.monotonically_increasing_id()), "radix")
    differ = at.agg(*[(F.bit_or(k).bitwiseXOR(F.bit_and(k))).alias(k) for k in keys]).first()
    mask = (1 << digit_bits) - 1
    passes = [(k, shift) for k in reversed(keys) for shift in range(0, 64, digit_bits)
              if ((differ[k] or 0) & (1 << 64) - 1) >> shift & mask] or [(keys[0], 0)]
    for k, shift in passes:
        at = at.withColumn("range", F.shiftrightunsigned("at", range_bits)).withColumn("digit", F.shiftrightunsigned(k, shift).bitwiseAND(F.lit(mask)))
        counts = write_table(at.groupBy("range", "digit").agg(F.count(F.lit(1)).alias("n")), "radix-counts")
        digits = counts.groupBy("digit").agg(F.sum("n").alias("n"))  # at most 2**digit_bits rows
        digits = digits.select("digit", F.coalesce(F.sum("n").over(W.orderBy("digit").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        inner = F.coalesce(F.sum("n").over(W.partitionBy("digit").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        offsets = counts.withColumn("inner", inner).join(F.broadcast(digits), "digit").select("range", "digit", (F.col("base") + F.col("inner")).alias("offset"))
        place = F.row_number().over(W.partitionBy("range", "digit").orderBy("at")) - 1
        at = at.withColumn("place", place).join(offsets, ["range", "digit"]).select("row", *keys, (F.col("offset") + F.col("place")).alias("at"))
        at = write_table(at, "radix")
    return at.select("row", (F.col("at") + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = BUCKETS,
             longest: int = LONGEST_RUN, seed: int | str = 7) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_features, weight, score and rank.

    ``target`` (text) gives the distribution to draw towards.  Of the documents with at least
    ``least_words`` words, floor(percent of them) with the highest scores are ranked from 1, equal scores
    by ascending doc_id (null last); all others have a null rank.  Null and empty texts have no
    features and weight 0.  Repeated rows count and rank each; an empty table gives an empty
    result, an empty target no gain but that of rarity; very long texts are hashed in pieces; other columns
    are not read."""
    gain = gains(bucket_counts(F.col("text"), docs, buckets, longest), bucket_counts(F.col("text"), target, buckets, longest), buckets)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = weigh(rows, "text", gain, longest).withColumn("score", F.col("weight") + gumbel("doc_id", seed))
    rows = write_table(rows, "weighed")
    able = rows.where(F.col("n_words") >= least_words)
    seen = able.agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top")).first()
    smallest = F.lit(-(1 << 63))
    keys = able.select("row", (F.lit(seen["top"] or 0) - F.col("score")).alias("down"), F.col("doc_id").isNull().cast("bigint").alias("unnamed"),
                       F.coalesce(F.col("doc_id"), F.lit(0)).bitwiseXOR(smallest).alias("id"))
    drawn = radix_rank(keys, ["down", "unnamed", "id"]).where(F.col("rank") <= percent * seen["n"] // 100)
    return rows.join(drawn, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
