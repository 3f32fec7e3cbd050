"""Exact and approximate cosine top-k search (OP-R1, OP-R2, OP-R3, OP-T1, OP-T6).

Exact search never materialises the query x item pair table:

* ``broadcast`` plan: the query matrix (size checked against a byte budget) is
  broadcast once; ``mapInArrow`` scores each index partition in place with a
  numpy block product and emits only the per-partition top-k of every query
  (equal scores by key, as the final cut has them, so it stays exact).  The index is
  never shuffled.
* ``grid`` plan, for query sets over the budget: queries are hashed into Bq
  blocks, items into Bi blocks, each (query block, item block) cell is
  co-grouped and scored in numpy; cell sizes are bounded by construction.

Both end with one ``row_number`` cut per query (Catalyst adds a
``WindowGroupLimit`` before the shuffle), and a join that brings back the
payload columns for the k winners only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import write_table

DEFAULT_BROADCAST_BYTES = 256 << 20
GRID_ROWS, GRID_CELLS = 1 << 15, 2  # most rows of a side of a grid cell, and cells for each task that can run
LSH_ROWS, LSH_BYTES, LSH_QUERIES = 4096, 32 << 20, 4096  # least rows of a block of the LSH search, bytes of its vectors, queries answered at a time
SCORE_CELLS, QUERY_TILE = 1 << 20, 1024  # entries of one query x item score block (8 MB of float64), its queries
PAIRS = 8192  # pairs of rows scored one by one at a time
SIGNED_ROWS = 1024  # rows given LSH signatures at a time
OUT_ROWS = 1 << 16  # rows of an Arrow batch given back


def _norms(m: np.ndarray) -> np.ndarray:
    """Row norms; zero or NaN rows get NaN so they never score."""
    n = np.zeros(m.shape[0])
    for i in range(0, len(m) if m.size else 0, 4096):  # in double, whatever the type of ``m``
        x = m[i:i + 4096].astype(np.float64, copy=False)
        n[i:i + 4096] = np.sqrt(np.einsum("ij,ij->i", x, x))
    n[~(n > 0)] = np.nan
    return n


def _list_matrix(arr: pa.Array, dim: int | None, as_stored: bool = False) -> np.ndarray:
    """Rows of a list column, or of one of ``embedding.sparse_vectors``, as double, or with ``as_stored`` in the column's own type."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return np.zeros((0, dim or 0))
    sparse = pa.types.is_struct(arr.type)
    lengths = (pc.struct_field(arr, "size") if sparse else pc.list_value_length(arr)).to_numpy(zero_copy_only=False)
    d = dim if dim is not None else int(lengths[0])
    if not np.all(lengths == d):
        bad = int(lengths[lengths != d][0])
        raise ValueError(f"embedding dimension {bad} does not match the expected {d}")
    if sparse:
        at, values = (pc.struct_field(arr, c) for c in ("indices", "values"))
        rows = np.repeat(np.arange(n), pc.list_value_length(at).to_numpy(zero_copy_only=False))
        values = values.flatten().to_numpy(zero_copy_only=False)
        m = np.zeros((n, d), values.dtype if as_stored else np.float64)
        m[rows, at.flatten().to_numpy(zero_copy_only=False)] = values
        return m
    flat = arr.flatten().to_numpy(zero_copy_only=False)
    return (flat if as_stored else flat.astype(np.float64, copy=False)).reshape(n, d)


def _key_order(table: pa.Table | pa.RecordBatch, keys: Sequence[str], nulls: str = "at_end") -> np.ndarray:
    """Place of each row in ascending order of its key columns; ``nulls`` "at_start" is Spark's order."""
    place = np.empty(table.num_rows, np.int64)
    place[pc.sort_indices(table.select(list(keys)), [(c, "ascending") for c in keys], null_placement=nulls).to_numpy()] = np.arange(table.num_rows)
    return place


def _first_k(qi: np.ndarray, sims: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's first ``k`` rows by score, equal scores by place."""
    if len(qi) == 0:
        return np.zeros(0, np.int64)
    order = np.lexsort((place, -sims, qi))
    q = qi[order]
    first = np.r_[0, np.flatnonzero(np.diff(q)) + 1]
    nth = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[nth < k]


def _single_reach(m: np.ndarray, norms: np.ndarray) -> float:
    """The largest norm of whole-number rows, else infinity.  If the product of two sides' is under 2**24, single precision makes
    their dot products exactly: every partial sum is a whole number of at most that size (Cauchy-Schwarz)."""
    return float(np.nanmax(norms, initial=0.0)) if m.size and np.array_equal(m, np.rint(m), equal_nan=True) else math.inf


def _dots(x: np.ndarray, y: np.ndarray, x_reach: float, y_reach: float) -> np.ndarray:
    """Dot products of rows, as double would make them; in single precision where that is exact."""
    kind = np.float32 if x_reach * y_reach < 1 << 24 else np.float64
    return x.astype(kind, copy=False) @ y.astype(kind, copy=False).T


def _unit_single(m: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Rows of length one in single precision; NaN where there is no direction."""
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        return (m / norms[:, None]).astype(np.float32)


def _pair_cosines(qm: np.ndarray, qnorm: np.ndarray, xm: np.ndarray, xnorm: np.ndarray, qi: np.ndarray, ri: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (qi, ri) in double: dot / (|q| |x|), so exact dot products stay exact (integer-count vectors) and
    equal vectors always tie exactly."""
    sims = np.empty(len(qi))
    with np.errstate(divide="ignore", invalid="ignore"):
        for i in range(0, len(qi), PAIRS):
            q, r = qi[i:i + PAIRS], ri[i:i + PAIRS]
            sims[i:i + PAIRS] = np.einsum("ij,ij->i", qm[q].astype(np.float64, copy=False), xm[r].astype(np.float64, copy=False)) / (qnorm[q] * xnorm[r])
    return sims


def _block_candidates(qm: np.ndarray, qnorm: np.ndarray, xm: np.ndarray, xnorm: np.ndarray, place: np.ndarray, kmax: int,
                      least: np.ndarray | None = None):
    """Each query's first ``kmax`` items, by query, falling score and place; scores under a query's ``least`` are left out.

    Queries and items meet in tiles of SCORE_CELLS scores, and a tile's queries are cut to ``kmax`` before the next ones
    begin, so what is held grows with neither side.  A tile is scored in single precision; where that is not exact, what its
    rounding (at most ``slack``) leaves open is scored again in double: the result is that of double throughout.
    """
    q, n = qm.shape[0], xm.shape[0]
    found = []
    step = max(64, SCORE_CELLS // QUERY_TILE)
    slack = 2 * (qm.shape[1] + 4) * float(np.finfo(np.float32).eps)  # four times the bound of the rounding of a dot product of unit rows
    reaches = [_single_reach(xm[start:start + step], xnorm[start:start + step]) for start in range(0, n if q else 0, step)]
    for low in range(0, q if n else 0, QUERY_TILE):
        own, own_norm = qm[low:low + QUERY_TILE], qnorm[low:low + QUERY_TILE]
        reach = _single_reach(own, own_norm)
        own = own.astype(np.float32, copy=False) if reach < 1 << 24 else own
        asked = np.full(len(own), -np.inf) if least is None else least[low:low + QUERY_TILE]
        floor, unit = asked.copy(), _unit_single(own, own_norm)
        parts = []
        for start in range(0, n, step):
            block, block_norm = xm[start:start + step], xnorm[start:start + step]
            exact = reach * reaches[start // step] < 1 << 24
            if exact:
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = _dots(own, block, reach, reaches[start // step]) / (own_norm[:, None] * block_norm[None])
            else:
                s = unit @ _unit_single(block, block_norm).T
            off = 0.0 if exact else slack
            hit = s >= (floor - off).astype(s.dtype)[:, None]  # never for a NaN
            many = np.flatnonzero(np.count_nonzero(hit, axis=1) > kmax)
            if len(many):
                t = np.where(hit[many], s[many], s.dtype.type(-np.inf))
                kth = -np.partition(-t, kmax - 1, axis=1)[:, kmax - 1].astype(np.float64)  # kmax true scores reach kth - off
                hit[many] = t >= (kth - 2 * off).astype(s.dtype)[:, None]
                floor[many] = np.maximum(floor[many], kth - off)
            qi, ri = np.nonzero(hit)
            sims = s[qi, ri] if exact else _pair_cosines(own, own_norm, block, block_norm, qi, ri)
            use = np.isfinite(sims) & (sims >= asked[qi])
            qi, ri, sims = qi[use], ri[use], sims[use]
            keep = _first_k(qi, sims, place[ri + start], kmax)
            parts.append((qi[keep], ri[keep] + start, sims[keep]))
        qi, ri, sims = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = _first_k(qi, sims, place[ri], kmax)
        found.append((qi[keep] + low, ri[keep], sims[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _raise_least(least: np.ndarray, qi: np.ndarray, sims: np.ndarray, k: int) -> None:
    """The k-th score of each query that has k rows; rows are by query and falling score, at most k a query."""
    kth = np.flatnonzero(qi[k - 1:] == qi[:max(0, len(qi) - k + 1)]) + k - 1
    least[qi[kth]] = np.maximum(least[qi[kth]], sims[kth])


def _output_schema(index: DataFrame, queries: DataFrame, query_id: str,
                   key_cols: Sequence[str]) -> T.StructType:
    fields = [T.StructField(query_id, queries.schema[query_id].dataType, True)]
    fields += [T.StructField(c, index.schema[c].dataType, True) for c in key_cols]
    fields.append(T.StructField("similarity", T.DoubleType(), True))
    return T.StructType(fields)


def _keep_best(batches: Iterator[pa.RecordBatch], candidates, ids: pa.Array, kmax: int, vector_col: str, query_id: str,
               keys: Sequence[str], arrow_schema: pa.Schema, nulls: str = "at_end") -> Iterator[pa.RecordBatch]:
    """Each query's first ``kmax`` rows of all ``batches``.  ``candidates`` (batch, least) gives query, row of the batch and
    score, by query, and raises ``least``, the scores that a row of each query needs by then."""
    least = np.full(len(ids), -np.inf)
    seen: list[pa.RecordBatch] = []  # the keys of the rows so far; a candidate is three numbers
    n_seen = n_found = 0
    found: list[tuple] = []

    def compact() -> tuple:
        """The best so far; only their keys are kept."""
        nonlocal seen, n_seen
        rows = pa.Table.from_batches(seen)
        qi, ri, sims = (np.concatenate(x) for x in zip(*found, strict=True))
        held, ri = np.unique(ri, return_inverse=True)
        rows = rows.take(pa.array(held))
        keep = _first_k(qi, sims, _key_order(rows, keys, nulls)[ri], kmax)
        qi, ri, sims = qi[keep], ri[keep], sims[keep]
        _raise_least(least, qi, sims, kmax)
        held, ri = np.unique(ri, return_inverse=True)
        seen = rows.take(pa.array(held)).combine_chunks().to_batches()
        n_seen = len(held)
        return qi.astype(np.int32), ri.astype(np.int32), sims

    for batch in batches:
        if batch.num_rows == 0 or len(ids) == 0:
            continue
        if batch.column(vector_col).null_count:
            batch = batch.filter(batch.column(vector_col).is_valid())
            if batch.num_rows == 0:
                continue
        qi, ri, sims = candidates(batch, least)
        seen.append(batch.select(keys))
        found.append((qi.astype(np.int32), (ri + n_seen).astype(np.int32), sims))
        n_seen += batch.num_rows
        n_found += len(qi)
        if n_found > 2 * kmax * len(ids) + 65536 or n_seen > 2 * kmax * len(ids) + 262144:
            found = [compact()]
            n_found = len(found[0][0])
        del batch
        pa.default_memory_pool().release_unused()
    if not n_found:
        return
    qi, ri, sims = compact()
    key_rows = pa.Table.from_batches(seen)
    for i in range(0, len(qi), OUT_ROWS):
        rows = key_rows.take(pa.array(ri[i:i + OUT_ROWS]))
        out = {query_id: ids.take(pa.array(qi[i:i + OUT_ROWS])), **{c: rows.column(c) for c in keys}, "similarity": pa.array(sims[i:i + OUT_ROWS])}
        yield from pa.Table.from_pydict(out, schema=arrow_schema).to_batches()


def _broadcast_candidates(index: DataFrame, queries: DataFrame, kmax: int, key_cols,
                          vector_col: str, query_id: str, query_vector: str,
                          schema: T.StructType) -> DataFrame:
    spark = index.sparkSession
    qtab = queries.select(query_id, query_vector).toArrow()
    qids = qtab.column(0).combine_chunks() if qtab.num_rows else pa.array([], type=qtab.schema.field(0).type)
    qmat = _list_matrix(qtab.column(1), None) if qtab.num_rows else np.zeros((0, 0))
    dim = qmat.shape[1] if qtab.num_rows else None
    norms = _norms(qmat)
    if qtab.num_rows and pa.types.is_float32(qtab.schema.field(1).type.value_type):
        qmat = qmat.astype(np.float32)  # as stored; a tile of it becomes double when it is scored
    bc = spark.sparkContext.broadcast((qids, qmat, norms, dim))
    arrow_schema = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in schema.fields])
    keys = list(key_cols)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, qn, qnorm, d = bc.value

        def candidates(batch: pa.RecordBatch, least: np.ndarray):
            x = _list_matrix(batch.column(vector_col), d)
            found = _block_candidates(qn, qnorm, x, _norms(x), _key_order(batch, keys), kmax, least)
            _raise_least(least, found[0], found[2], kmax)
            return found

        yield from _keep_best(batches, candidates, ids, kmax, vector_col, query_id, keys, arrow_schema)

    # Rows without a vector are left out here: a filter in the plan would make every vector once more.
    return index.select(*keys, vector_col).mapInArrow(score, schema)


def _grid_candidates(index: DataFrame, queries: DataFrame, kmax: int, key_cols,
                     vector_col: str, query_id: str, query_vector: str,
                     schema: T.StructType, n_queries: int,
                     query_rows: int | None, item_rows: int | None) -> DataFrame:
    """Each query goes out once for every item block and each item once for every query block, so the blocks are as
    large as a task can hold (GRID_ROWS), but not so large that there are too few cells for the cluster's tasks."""
    queries = write_table(queries.select(query_id, query_vector), "grid-queries")  # made once, counted and dealt
    index = write_table(index.select(*key_cols, vector_col), "grid-items")
    n_items = index.count()
    side = math.isqrt(max(1, n_queries * n_items) // (GRID_CELLS * index.sparkSession.sparkContext.defaultParallelism)) + 1
    query_rows, item_rows = (x or min(GRID_ROWS, max(4096, side)) for x in (query_rows, item_rows))
    bq = max(1, math.ceil(n_queries / query_rows))
    bi = max(1, math.ceil(n_items / item_rows))
    keys = list(key_cols)
    q_side = (queries.select(F.col(query_id), F.col(query_vector).alias("_qv"))
              .withColumn("_qb", F.pmod(F.xxhash64(query_id), F.lit(bq)).cast("int"))
              .withColumn("_ib", F.explode(F.sequence(F.lit(0), F.lit(bi - 1)))))
    i_side = (index.select(*keys, F.col(vector_col).alias("_iv"))
              .withColumn("_ib", F.pmod(F.xxhash64(*keys), F.lit(bi)).cast("int"))
              .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(bq - 1)))))

    # Both sides number their blocks in the same type: the hash that deals out cells is not that of an equal bigint, and the
    # two sides of a cell would lie in different tasks.
    return q_side.groupBy("_qb", "_ib").cogroup(i_side.groupBy("_qb", "_ib")).applyInArrow(_cell_scorer(schema, query_id, keys, kmax), schema)


def _cell_scorer(schema: T.StructType, query_id: str, keys: Sequence[str], k: int):
    """Scores the queries (``_qv``) of a cell against its items (``_iv``): each query's first ``k``."""
    out = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in schema.fields])

    def cell(own: pa.Table, items: pa.Table) -> pa.Table:
        if not own.num_rows or not items.num_rows:
            return out.empty_table()
        qm = _list_matrix(own["_qv"], None, as_stored=True)
        xm = _list_matrix(items["_iv"], qm.shape[1], as_stored=True)
        qi, ri, sims = _block_candidates(qm, _norms(qm), xm, _norms(xm), _key_order(items, keys), k)
        return pa.table([own[query_id].take(pa.array(qi)), *(items[c].take(pa.array(ri)) for c in keys), pa.array(sims)], schema=out)

    return cell


def _arrow_type(dt: T.DataType) -> pa.DataType:
    mapping = {
        T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.ShortType: pa.int16(),
        T.StringType: pa.string(), T.DoubleType: pa.float64(), T.FloatType: pa.float32(),
        T.BooleanType: pa.bool_(),
    }
    for cls, at in mapping.items():
        if isinstance(dt, cls):
            return at
    raise TypeError(f"unsupported key type {dt}")


def vector_topk(index: DataFrame, queries: DataFrame, k: int = 5, *,
                key_cols: Sequence[str] = ("source_path", "chunk_index"),
                payload_cols: Sequence[str] = ("content",),
                vector_col: str = "embedding",
                query_id: str = "query_id",
                query_vector: str = "embedding",
                limit_col: str | None = None,
                strategy: str = "auto",
                max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
                grid_query_rows: int | None = None,
                grid_item_rows: int | None = None) -> DataFrame:
    """Exact cosine top-k of ``index`` rows for every row of ``queries``.

    Output: ``query_id, rank, *key_cols, *payload_cols, similarity``; ranks are
    1..k ordered by similarity desc, then the key columns (total order).
    ``limit_col`` names a per-query limit column (<= k) in ``queries``.
    Rows with a null, zero or NaN vector never score (OP-P17).
    """
    if isinstance(k, bool) or not isinstance(k, int) or k <= 0:
        raise ValueError("num_results must be a positive integer")
    keys = list(key_cols)
    idx = index.where(F.col(vector_col).isNotNull())
    q = queries.where(F.col(query_vector).isNotNull())
    schema = _output_schema(index, queries, query_id, keys)

    n_queries = q.count()
    dim_row = q.select(F.size(query_vector).alias("d")).head(1)
    dim = dim_row[0]["d"] if dim_row else 0
    if strategy == "auto":
        strategy = "broadcast" if n_queries * max(dim, 1) * 8 <= max_broadcast_bytes else "grid"
    if strategy == "broadcast":
        cand = _broadcast_candidates(index, q, k, keys, vector_col, query_id, query_vector, schema)
    elif strategy == "grid":
        cand = _grid_candidates(idx, q, k, keys, vector_col, query_id, query_vector, schema,
                                n_queries, grid_query_rows, grid_item_rows)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")

    w = Window.partitionBy(query_id).orderBy(F.col("similarity").desc(), *[F.col(c).asc() for c in keys])
    top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if limit_col is not None:
        top = (top.join(F.broadcast(q.select(query_id, limit_col))
                        if n_queries * 16 <= max_broadcast_bytes else q.select(query_id, limit_col),
                        query_id)
               .where(F.col("rank") <= F.col(limit_col)).drop(limit_col))
    top = top.withColumn("rank", F.col("rank").cast("int"))
    if payload_cols:
        # The winners are at most n_queries * k rows: a proven bound, so they can be
        # broadcast against a pruned re-scan of the index instead of shuffling it.
        payload = index.select(*keys, *payload_cols)
        winners = F.broadcast(top) if n_queries * k * 64 <= max_broadcast_bytes else top
        top = payload.join(winners, keys, "inner")
    return top.select(query_id, "rank", *keys, *payload_cols, "similarity")


def cosine_expr(a: str, b: str):
    """Built-in cosine of two array<float> columns (OP-R1, small inputs only)."""
    dot = F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x.cast("double") * y.cast("double")),
                      F.lit(0.0).cast("double"), lambda acc, v: acc + v)
    na = F.sqrt(F.aggregate(F.col(a), F.lit(0.0).cast("double"), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    nb = F.sqrt(F.aggregate(F.col(b), F.lit(0.0).cast("double"), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    return F.when((na > 0) & (nb > 0), dot / (na * nb))


def sign_planes(n: int, dim: int, seed: int) -> np.ndarray:
    """n x dim of 1 and -1: 1 where the md5 of ``seed|plane|component`` begins with 8 to f."""
    return np.array([[1.0 if hashlib.md5(f"{seed}|{i}|{j}".encode()).digest()[0] >> 7 else -1.0 for j in range(dim)] for i in range(n)]).reshape(n, dim)


def _signer(dim: int, bands: int, bits: int, seed: int, probes: int):
    """A function that gives rows their signatures: rows x bands x (own one and the likeliest others, ``probes`` in all)."""
    planes = sign_planes(bands * bits, dim, seed)
    weights = (1 << np.arange(bits)).astype(np.int64)
    masks = np.array([0, *(1 << i for i in range(bits)), *(1 << i | 1 << j for i in range(bits) for j in range(i))])
    probes = min(probes, len(masks))
    flips = (masks[:, None] >> np.arange(bits)) & 1

    def sign(x: np.ndarray) -> np.ndarray:
        side = (x @ planes.T).reshape(len(x), bands, bits)
        sig = ((side > 0) * weights).sum(axis=2)[:, :, None]
        if probes > 1:
            sig = sig ^ masks[np.argsort(side ** 2 @ flips.T, axis=2, kind="stable")[:, :, :probes]]
        return sig

    return sign


def lsh_signatures(df: DataFrame, id_cols, vector_col: str, dim: int, bands: int = 8, bits: int = 8,
                   seed: int = 17, probes: int = 1) -> DataFrame:
    """Sign-random-projection signatures (Charikar 2002): one row per (row, band, signature).

    With ``probes`` above 1 each band also has the neighbouring signatures (at most two bits
    flipped) whose flipped projections are the smallest (Lv et al. 2007).

    The hyperplanes are a (bands*bits x dim) matrix of signs (Achlioptas 2003), each from an md5 of
    its place, so that SQL can state them.  The matrix is tiny and fixed by the parameters: it travels in the
    task closure, and numpy does the projection per Arrow batch.
    """
    sign = _signer(dim, bands, bits, seed, probes)
    ids = list(id_cols)  # may hold the vector too
    schema = T.StructType([*[df.schema[c] for c in ids], T.StructField("band", T.IntegerType()),
                           T.StructField("sig", T.LongType())])

    def project(batches):
        # A row is given back bands * probes times, vector and all: a slice of a batch at a time.
        for batch in (b.slice(i, SIGNED_ROWS) for b in batches for i in range(0, b.num_rows, SIGNED_ROWS)):
            sig = sign(_list_matrix(batch.column(vector_col), dim))
            each = sig.shape[2]
            rows = np.repeat(np.arange(batch.num_rows), bands * each)
            cols = [batch.column(c).take(pa.array(rows)) for c in ids]
            yield pa.RecordBatch.from_arrays(
                cols + [pa.array(np.tile(np.repeat(np.arange(bands, dtype=np.int32), each), batch.num_rows)),
                        pa.array(sig.reshape(-1).astype(np.int64))], names=[*ids, "band", "sig"])

    return df.where(F.col(vector_col).isNotNull()).select(*dict.fromkeys([*ids, vector_col])).mapInArrow(project, schema)


def vector_topk_lsh(index: DataFrame, queries: DataFrame, k: int = 5, *,
                    key_cols=("source_path", "chunk_index"), vector_col: str = "embedding",
                    query_id: str = "query_id", query_vector: str = "embedding",
                    bands: int = 16, bits: int = 6, seed: int = 17, probes: int = 3) -> DataFrame:
    """Approximate top-k: candidates share a (band, signature) bucket with the query or
    one of its ``probes`` likeliest buckets a band.  Queries and items are dealt into blocks by a hash; two blocks meet in one task,
    which makes their signatures, scores the rows of its buckets exactly and gives each query's first k only.  So a vector is sent
    once for each block of the other side, not for every bucket, and no candidate pair is ever shuffled.  Returns
    query_id, rank, keys, similarity; recall is measured against ``vector_topk``."""
    keys = list(key_cols)
    dim_row = queries.select(F.size(query_vector).alias("d")).head(1)
    if not dim_row:
        return index.sparkSession.createDataFrame([], _output_schema(index, queries, query_id, keys))
    dim = dim_row[0]["d"]
    schema = _output_schema(index, queries, query_id, keys)
    qs = write_table(queries.where(F.col(query_vector).isNotNull()).select(query_id, F.col(query_vector).alias("_qv")), "lsh-queries")
    ix = write_table(index.where(F.col(vector_col).isNotNull()).select(*keys, F.col(vector_col).alias("_iv")), "lsh-items")
    nq, ni = qs.count(), ix.count()
    side = math.isqrt(max(1, nq * ni) // (GRID_CELLS * index.sparkSession.sparkContext.defaultParallelism)) + 1
    rows = min(max(1, LSH_BYTES // (4 * max(1, dim))), max(LSH_ROWS, side))
    bq, bi = max(1, math.ceil(nq / rows)), max(1, math.ceil(ni / rows))
    block = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    q_side = qs.withColumn("_qb", block(bq, query_id, "_qv")).withColumn("_ib", F.explode(F.sequence(F.lit(0), F.lit(bi - 1))))
    i_side = ix.withColumn("_ib", block(bi, *keys, "_iv")).withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(bq - 1))))
    out = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in schema.fields])

    def meet(own: pa.Table, items: pa.Table) -> pa.Table:
        if not own.num_rows or not items.num_rows:
            return out.empty_table()
        qm, xm = _list_matrix(own["_qv"], dim, as_stored=True), _list_matrix(items["_iv"], dim, as_stored=True)
        found = _bucket_candidates(qm, xm, _key_order(items, keys), _key_numbers(items, keys), k, _signer(dim, bands, bits, seed, 1), _signer(dim, bands, bits, seed, probes))
        qi, ri, sims = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([own[query_id].take(pa.array(qi)), *(items[c].take(pa.array(ri)) for c in keys), pa.array(sims)], schema=out)

    found = q_side.groupBy("_qb", "_ib").cogroup(i_side.groupBy("_qb", "_ib")).applyInArrow(meet, schema)
    # Rows of equal keys, or of equal query ids, count once.
    scored = found.groupBy(query_id, *keys).agg(F.max("similarity").alias("similarity"))
    w = Window.partitionBy(query_id).orderBy(F.col("similarity").desc(), *[F.col(c).asc() for c in keys])
    return (scored.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
            .select(query_id, "rank", *keys, "similarity"))


def _key_numbers(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """A number for each row in order of its keys, the same for equal keys."""
    order = pc.sort_indices(table.select(list(keys)), [(c, "ascending") for c in keys])
    new = np.zeros(table.num_rows, bool)
    for c in keys:
        code = table[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.take(order).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    number = np.empty(table.num_rows, np.int64)
    number[order.to_numpy()] = np.cumsum(new)
    return number


def _bucket_candidates(qm: np.ndarray, xm: np.ndarray, place: np.ndarray, number: np.ndarray, k: int, own_sign, probe_sign) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each query's first ``k`` of the items that share a bucket with it, as (query, item, score), some queries at a time.  Of items
    of one ``number`` the best counts."""
    buckets = []  # of each band: items by signature, the signatures and where they end
    sig = np.concatenate([own_sign(xm[i:i + SIGNED_ROWS].astype(np.float64))[:, :, 0] for i in range(0, len(xm), SIGNED_ROWS)])
    for band in range(sig.shape[1]):
        order = np.argsort(sig[:, band], kind="stable")
        value, first = np.unique(sig[order, band], return_index=True)
        buckets.append((dict(zip(value.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True), strict=True)), order))
    norms = _norms(xm)
    alone = int(number.max()) + 1 == len(number)  # no two items of one number: what a query has found bounds what it needs
    for low in range(0, len(qm), LSH_QUERIES):
        x = qm[low:low + LSH_QUERIES]
        x_norms, least = _norms(x), np.full(len(x), -np.inf)
        probed = np.concatenate([probe_sign(x[i:i + SIGNED_ROWS].astype(np.float64)) for i in range(0, len(x), SIGNED_ROWS)])
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for band, (places, order) in enumerate(buckets):
            flat = probed[:, band].ravel()
            by = np.argsort(flat, kind="stable")
            value, first = np.unique(flat[by], return_index=True)
            for v, i, j in zip(value.tolist(), first, [*first[1:], len(by)], strict=True):
                if v in places:
                    q, rows = by[i:j] // probed.shape[2], order[slice(*places[v])]
                    qi, ri, sims = _block_candidates(x[q], x_norms[q], xm[rows], norms[rows], place[rows], k, least[q])
                    if alone:
                        _raise_least(least, q[qi], sims, k)
                    found.append((q[qi], rows[ri], sims))
        qi, ri, sims = (np.concatenate(f) for f in zip(*found, strict=True))
        order = np.lexsort((-sims, number[ri], qi))  # a pair may have met in several bands
        qi, ri, sims = qi[order], ri[order], sims[order]
        new = np.flatnonzero((np.diff(qi, prepend=-1) != 0) | (np.diff(number[ri], prepend=-1) != 0))
        qi, ri, sims = qi[new], ri[new], sims[new]
        keep = _first_k(qi, sims, number[ri], k)
        yield qi[keep] + low, ri[keep], sims[keep]


def recall_at_k(approx: DataFrame, exact: DataFrame, query_id: str, keys) -> DataFrame:
    """Share of exact top-k rows that the approximate search also returned."""
    hit = exact.join(approx.select(query_id, *keys).withColumn("_hit", F.lit(1)), [query_id, *keys], "left")
    return hit.agg(F.count(F.lit(1)).alias("exact_rows"), F.count("_hit").alias("found"),
                   (F.count("_hit") / F.count(F.lit(1))).alias("recall"))
