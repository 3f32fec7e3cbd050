"""Memory of a Python worker handed back to the system when its task ends.

Workers are reused by later stages of a job.  What a task freed would otherwise stay with the
process, beside the heap of the executor, while the next stage's tasks ask for more."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa


def release() -> None:
    """Hand memory that was freed in this worker back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def tidy(batches_fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow that releases memory after each batch it gives and at its end."""
    @functools.wraps(batches_fn)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in batches_fn(batches):
            yield out
            del out
            release()
        release()
    return run
