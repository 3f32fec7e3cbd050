"""Text embedding (OP-C12) and the vector text codec (OP-C13).

Default embedder: feature hashing.  The JVM splits tokens; an Arrow UDF hashes each
distinct one of a batch (md5 prefix -> bucket) and counts the buckets of all rows with
``numpy.bincount``.  A model embedder plugs in through
``embed_with`` (iterator pandas UDF, model loaded once per task); both check
the dimension.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import tokens

# Fixed value: vector dimension of the reference's default configuration.
DEFAULT_DIM = 384
#: Rows of an Arrow batch that are counted at a time.
COUNTED_ROWS = 512
#: Rows whose tokens are told apart at a time.
HASHED_ROWS = 4096


def hash_bucket(token: str, dim: int) -> int:
    """First 32 bits of md5(token) modulo dim (same rule in DuckDB for the oracle)."""
    return int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big") % dim


def _buckets(words: pa.Array, dim: int) -> np.ndarray:
    """``hash_bucket`` of each word."""
    md5 = hashlib.md5
    digests = b"".join([md5(w).digest() for w in words.cast(pa.binary()).to_pylist()])
    return (np.frombuffer(digests, ">u4")[::4] % dim).astype(np.int32)


def _counts(buckets: pa.Array, dim: int) -> pa.Array:
    """Count vectors of bucket lists (null: null), slice by slice: one bincount over (row * dim + bucket)."""
    n = len(buckets)
    counts = np.empty((n, dim), np.float32)
    for i in range(0, n, COUNTED_ROWS):  # a slice's tokens at a time, however long the texts of a batch
        part = buckets.slice(i, COUNTED_ROWS)
        lengths = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
        values = pc.list_flatten(part).to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.repeat(np.arange(len(part), dtype=np.int64), lengths)
        counts[i:i + len(part)] = np.bincount(rows * dim + values, minlength=len(part) * dim).reshape(len(part), dim)
    counts = counts.reshape(-1)
    offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(counts), mask=buckets.is_null())


def _bincount_udf(dim: int):
    @F.arrow_udf("array<float>")
    def bincount(buckets: pa.Array) -> pa.Array:
        return _counts(buckets.combine_chunks() if isinstance(buckets, pa.ChunkedArray) else buckets, dim)
    return bincount


def _hashing_udf(dim: int):
    @F.arrow_udf("array<float>")
    def embed(words: pa.Array) -> pa.Array:
        """A token that occurs often in a batch is hashed once."""
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        parts = []
        for i in range(0, len(words), HASHED_ROWS):
            part = words.slice(i, HASHED_ROWS)
            found = pc.list_flatten(part).dictionary_encode()
            bucket = _buckets(found.dictionary, dim)
            lengths = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
            parts.append(_counts(pa.ListArray.from_arrays(offsets, pa.array(bucket[found.indices.to_numpy()]), mask=part.is_null()), dim))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))
    return embed


def embed_hashing(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = DEFAULT_DIM) -> DataFrame:
    """Term-count vector over ``dim`` hashed buckets (cosine-ready, no normalisation needed)."""
    return df.withColumn(out_col, _hashing_udf(dim)(tokens(text_col)))


def _sparse(vectors: pa.Array) -> pa.Array:
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int32)
    flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False)
    at, ends = np.flatnonzero(flat), np.cumsum(size, dtype=np.int64)
    row = np.searchsorted(ends, at, side="right")
    offsets = pa.array(np.r_[0, np.searchsorted(at, ends)].astype(np.int32))
    parts = {"size": pa.array(size), "indices": pa.ListArray.from_arrays(offsets, pa.array((at - (ends - size)[row]).astype(np.int32))),
             "values": pa.ListArray.from_arrays(offsets, pa.array(flat[at].astype(np.float32)))}
    return pa.StructArray.from_arrays(list(parts.values()), names=list(parts), mask=vectors.is_null())


def sparse_vectors(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The array<float> ``vector_col`` as its size and the indices and values of what is not zero (null: null): a line
    has a few tens of tokens and 384 components, all of which would be written, shuffled and turned into Arrow by every
    pass.  The searches and cells take either form.  One pass over batches, so that an embedder below runs once."""
    at = df.columns.index(vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([_sparse(c) if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    kind = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.FloatType()))])
    return df.mapInArrow(run, T.StructType([T.StructField(f.name, kind) if f.name == vector_col else f for f in df.schema.fields]))


def embed_with(df: DataFrame, text_col: str, load_model: Callable[[], Callable[[list[str]], np.ndarray]],
               dim: int, out_col: str = "embedding") -> DataFrame:
    """Pluggable model embedder: ``load_model()`` runs once per task, then batches of texts."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in batches:
            vecs = np.asarray(model(texts.tolist()), dtype=np.float32)
            if vecs.ndim != 2 or vecs.shape[1] != dim:
                raise ValueError(f"embedding dimension {vecs.shape[-1]} does not match VECTOR_DIMENSIONS={dim}")
            yield pd.Series(list(vecs))

    return df.withColumn(out_col, embed(F.col(text_col)))


def check_dimension(df: DataFrame, col: str, dim: int) -> DataFrame:
    """Fail the job on a vector of the wrong size (``raise_error`` inside the plan)."""
    return df.withColumn(col, F.when(F.col(col).isNull() | (F.size(col) == dim), F.col(col))
                         .otherwise(F.raise_error(F.concat(F.lit("embedding dimension "),
                                                           F.size(col).cast("string"),
                                                           F.lit(f" does not match VECTOR_DIMENSIONS={dim}")))))


def vector_to_string(c: Column | str) -> Column:
    """``[a,b,...]`` text form used by vector SQL literals."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("]"))


def string_to_vector(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.from_json(c, "array<float>")
