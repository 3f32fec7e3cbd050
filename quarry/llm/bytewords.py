"""Words of UTF-8 texts found on whole Arrow columns of bytes, without a string a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: What stands between words once a text is normalised.
GAP = b"\x00"


def word_table(letters: bytes) -> bytes:
    """Table for bytes.translate: word bytes (``letters`` and all from 0x80), A-Z as a-z, others as GAP."""
    table = bytearray(256)
    for c in [*letters, *range(0x80, 0x100)]:
        table[c] = c
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = table[c + 32]
    return bytes(table)


def column_bytes(col: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each value of a string column; null is empty."""
    col = col.cast(pa.large_binary())
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = memoryview(col.buffers()[2] or b"")
    for i in range(len(col)):
        yield bytes(data[at[i]:at[i + 1]]) if col[i].is_valid else b""


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes other than GAP."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.not_equal(data, 0, out=inside[1:-1])
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    return turn[::2], turn[1::2]
