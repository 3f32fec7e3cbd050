"""Vectors in cells of a coarse quantiser: approximate top-k and the exact cosine join (OP-R3, OP-J3, OP-B1).

Spherical k-means over a bounded sample gives the centroids; every row is assigned to its nearest
one and keeps its angle to it.  A cell over ``max_rows`` rows is split into chunks by a hash of
the row, so no task holds more than that many rows of the index and as many visitors.

* ``search_cells`` sends each query to the cells whose centroids are nearest (its probe list).
  ``calibrated_probes`` chooses the length of the list by measured recall on a bounded sample of queries.
* ``cosine_join`` finds all pairs at or above a threshold.  Rows are dealt into large blocks, and each
  pair of blocks meets once, in one task, where rows lie in tiles by cell and angle.  By the triangle inequality the
  angles of two similar rows to any centroid differ by at most the threshold's angle; tiles beyond that never meet.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.vector_search import (
    DEFAULT_BROADCAST_BYTES, GRID_CELLS, _arrow_type, _block_candidates, _dots, _keep_best, _key_order, _list_matrix, _norms, _raise_least, _single_reach,
    vector_topk,
)
from quarry.session import checkpoint_dir, write_table

#: Rows of the training sample, most centroids, rounds of k-means.
SAMPLE, MOST_CELLS, ROUNDS = 16_384, 2048, 10
#: Rows of a chunk of a cell, and of a block of its visitors.
MAX_ROWS = 4096
#: Rows that meet the centroids at a time, and rows of an Arrow batch given back.
SLICE, OUT_ROWS = 512, 4096
#: Centroids a row that single precision cannot tell apart, on average, up to which they are compared one by one.
TIED = 16
#: Chunks of a cell that are written to one file.
FILE_CHUNKS = 8
#: Rows of a cell of the join, on average; most of its cells, and most rows of a side of its blocks.
JOIN_ROWS, PIVOTS, JOIN_BLOCK = 1024, 64, 1 << 15
#: Slack of angle bounds, well above the rounding of arccos.
SLACK = 1e-6
#: Entries of a score block.
BLOCK = 1 << 20


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most SLICE rows, so that rows x cells stays small."""
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            yield b.slice(i, SLICE)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; rows without a direction are NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / _norms(m)[:, None]


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def kmeans(points: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """Unit centroids of unit ``points``; an empty cell takes the point furthest from its own centroid."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    centroids = distinct[np.sort(rng.choice(len(distinct), min(k, len(distinct)), replace=False))]
    for _ in range(rounds):
        s = points @ centroids.T
        own = s.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        far = np.argsort(s[np.arange(len(points)), own], kind="stable")
        empty = np.flatnonzero(~(np.linalg.norm(sums, axis=1) > 0))
        sums[empty] = points[far[:len(empty)]]
        centroids = sums / np.linalg.norm(sums, axis=1)[:, None]
    return centroids


def train_cells(vectors: DataFrame, vector_col: str, n_cells: int | None = None, sample: int = SAMPLE, hash_col: str | None = None) -> np.ndarray:
    """Centroids (cells x dimension) from the ``sample`` vectors of least hash (``hash_col``, if the rows hold it); about twice
    the square root of the number of rows, at most MOST_CELLS, unless ``n_cells`` says how many.

    The hashes are counted by their first twelve bits, so that only the vectors of the least ones are sorted: else each
    task would send ``sample`` vectors to the one that draws."""
    checkpoint_dir(vectors.sparkSession)
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(vector_col).alias("v"), (F.col(hash_col) if hash_col else F.xxhash64(vector_col)).alias("h"))
    counts = sorted(rows.groupBy(F.shiftright("h", 52).alias("b")).count().collect())  # at most 4096 rows
    n = sum(r["count"] for r in counts)
    k = n_cells or max(1, min(MOST_CELLS, 2 * math.isqrt(n)))
    enough = np.searchsorted(np.cumsum([r["count"] for r in counts]), min(n, sample))  # the bucket that fills the sample
    if enough + 1 < len(counts):
        rows = rows.where(F.shiftright("h", 52) <= counts[enough]["b"])
    drawn = rows.orderBy("h").limit(sample)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unit(_list_matrix(b.column(0), None)) for b in batches if b.num_rows]
        points = np.concatenate(parts) if parts else np.zeros((0, 0))
        points = points[~np.isnan(points).any(axis=1)]
        if len(points):
            c = kmeans(points, k)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()]), pa.array([len(c)])], ["c", "n"])

    got = drawn.select("v").coalesce(1).mapInArrow(train, "c binary, n bigint").collect()  # one row: the centroids
    return np.frombuffer(got[0]["c"]).reshape(got[0]["n"], -1) if got else np.zeros((0, 0))


def nearest(u: np.ndarray, centroids: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each unit vector, the first of its nearest centroids, and the cosine to it.  ``single``: the centroids in
    single precision, in which the cosines are made; rows whose best two its rounding could swap are told apart in double."""
    s = u.astype(np.float32) @ single.T
    own, cell = np.arange(len(s)), s.argmax(axis=1)
    close = s[own, cell] - 2 * (u.shape[1] + 2) * np.finfo(np.float32).eps
    best = s[own, cell]
    s[own, cell] = -np.inf
    many = np.flatnonzero(s.max(axis=1, initial=-np.inf) >= close)
    s[own, cell] = best
    row, of = np.nonzero(s[many] >= close[many, None])
    if len(row) > TIED * len(many):  # nearly equal centroids
        cell[many] = (u[many] @ centroids.T).argmax(axis=1)
    elif len(many):
        exact = np.einsum("ij,ij->i", u[many[row]], centroids[of])
        order = np.lexsort((of, -exact, row))
        cell[many] = of[order[np.flatnonzero(np.diff(row, prepend=-1))]]
    return cell, np.einsum("ij,ij->i", u, centroids[cell])


def assign_cells(rows: DataFrame, centroids: np.ndarray, vector_col: str) -> DataFrame:
    """``rows`` with cell and angle (to the cell's centroid); rows without a direction drop out."""
    held = rows.sparkSession.sparkContext.broadcast(centroids)  # at most MOST_CELLS vectors
    at = rows.columns.index(vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        single = c.astype(np.float32)
        for b in slices(batches) if len(c) else ():
            u = unit(_list_matrix(b.column(at), c.shape[1]))
            use = np.flatnonzero(~np.isnan(u).any(axis=1))
            cell, cosine = nearest(u[use], c, single)
            b = b.take(pa.array(use))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(angle(cosine))], [*b.schema.names, "cell", "angle"])

    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    return rows.where(F.col(vector_col).isNotNull()).mapInArrow(run, schema)


def _per_cell(numbers: np.ndarray):
    """The number of the row's cell, from one literal array (a map would be searched entry by entry)."""
    return F.get(F.split(F.lit(",".join(map(str, numbers)) or "1"), ",").cast("array<bigint>"), F.col("cell"))


@dataclass
class CellIndex:
    """A stored table partitioned by cell (key columns, vector, angle, chunk), its centroids, and each
    cell's rows, chunks and radius."""
    table: DataFrame
    keys: tuple[str, ...]
    vector: str
    centroids: np.ndarray
    rows: np.ndarray
    chunks: np.ndarray
    radius: np.ndarray


def build_cells(index: DataFrame, key_cols: Sequence[str], vector_col: str = "embedding", centroids: np.ndarray | None = None,
                n_cells: int | None = None, max_rows: int = MAX_ROWS, hash_col: str | None = None) -> CellIndex:
    """Assign every row of ``index`` to a cell and store it, partitioned by cell; ``hash_col`` as in ``train_cells``."""
    spark = index.sparkSession
    keys = tuple(key_cols)
    if centroids is None:
        centroids = train_cells(index, vector_col, n_cells, hash_col=hash_col)
    flat = write_table(assign_cells(index.select(*keys, vector_col), centroids, vector_col), "assigned")
    n = len(centroids)
    rows, radius = np.zeros(n, np.int64), np.zeros(n)
    for r in flat.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r")).collect():  # a row a cell
        rows[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    chunks = np.maximum(1, -(-rows // max_rows))
    flat = flat.withColumn("chunk", F.pmod(F.xxhash64(*keys), _per_cell(chunks)).cast("int"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/cells-{uuid.uuid4().hex}"
    flat.repartition("cell", F.floor(F.col("chunk") / FILE_CHUNKS)).write.partitionBy("cell").parquet(path)
    schema = T.StructType([*[f for f in flat.schema.fields if f.name != "cell"], T.StructField("cell", T.IntegerType())])
    return CellIndex(spark.read.schema(schema).parquet(path), keys, vector_col, centroids, rows, chunks, radius)


def _visits(rows: DataFrame, row_id: str, vector_col: str, choose, chunks: np.ndarray, max_rows: int) -> tuple[DataFrame, np.ndarray]:
    """Each row once for every chunk of every cell that ``choose`` (unit vectors, batch -> mask and value of rows x cells)
    sends it to: its columns with cell, chunk, block and value.  Visitors of a cell are dealt over blocks of about
    ``max_rows`` by a hash of their id; also the blocks of each cell."""
    sc = rows.sparkSession.sparkContext
    rows = rows.withColumn("deal", F.shiftrightunsigned(F.xxhash64(row_id), 1))
    at, deal_at = rows.columns.index(vector_col), rows.columns.index("deal")
    n_cells = len(chunks)

    def sent(b: pa.RecordBatch):
        mask, value = choose(unit(_list_matrix(b.column(at), None)), b)
        row, cell = np.nonzero(mask)
        return row, cell, value[row, cell]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_cells, np.int64)
        for b in slices(batches):
            n += np.bincount(sent(b)[1], minlength=n_cells)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(n[held])], ["cell", "n"])

    visitors = np.zeros(n_cells, np.int64)
    for r in rows.mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row a cell
        visitors[r["cell"]] = r["n"]
    blocks = np.maximum(1, -(-visitors // max_rows))
    held = sc.broadcast((chunks, blocks))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, blocks = held.value
        for b in slices(batches):
            row, cell, value = sent(b)
            block = (b.column(deal_at).to_numpy()[row] % blocks[cell]).astype(np.int32)
            n = chunks[cell]
            copy = np.repeat(np.arange(len(cell)), n)
            chunk = (np.arange(len(copy)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            for i in range(0, len(copy), OUT_ROWS):  # a row goes out once a cell and chunk, vector and all
                part = copy[i:i + OUT_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [*b.take(pa.array(row[part])).columns, pa.array(cell[part].astype(np.int32)), pa.array(chunk[i:i + OUT_ROWS]), pa.array(block[part]), pa.array(value[part])],
                    [*b.schema.names, "cell", "chunk", "block", "value"])

    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.IntegerType()) for c in ("cell", "chunk", "block")], T.StructField("value", T.DoubleType())])
    return rows.mapInArrow(deal, schema), blocks


def _homes(index: CellIndex, blocks: np.ndarray) -> DataFrame:
    """The stored rows, once for every block of their cell's visitors."""
    if not (blocks > 1).any():
        return index.table.withColumn("block", F.lit(0))
    return index.table.withColumn("block", F.explode(F.sequence(F.lit(0), (_per_cell(blocks) - 1).cast("int"))))


def _tiles(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray, most: int) -> tuple[np.ndarray, list[slice], np.ndarray, np.ndarray]:
    """Rows by nearest centroid and angle to it, cut into tiles of one centroid and at most ``most`` rows: the order, the
    tiles, and each tile's least and largest angle to every centroid.  Rows without a direction are left out."""
    use = np.flatnonzero(np.isfinite(norms))
    theta = np.empty((len(use), len(centroids)))
    for i in range(0, len(use), SLICE):
        part = use[i:i + SLICE]
        theta[i:i + SLICE] = angle(x[part].astype(np.float64) / norms[part, None] @ centroids.T)
    cell = theta.argmin(axis=1)
    order = np.lexsort((theta[np.arange(len(use)), cell], cell))
    edge = np.array([i for p in _runs(cell[order])[1] for i in range(p.start, p.stop, most)], np.int64)
    if not len(edge):
        return use, [], np.zeros((0, len(centroids))), np.zeros((0, len(centroids)))
    theta = theta[order]
    return use[order], [slice(a, b) for a, b in zip(edge, [*edge[1:], len(use)], strict=True)], np.minimum.reduceat(theta, edge), np.maximum.reduceat(theta, edge)


def _alike(x: np.ndarray, y: np.ndarray, centroids: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of x, rows of y, cosines of x rows x y rows), tile by tile, of all tiles that can hold a pair at ``threshold``: by
    the triangle inequality the angles of such a pair to any centroid differ by no more than the threshold's angle."""
    reach = math.acos(max(-1.0, min(1.0, threshold))) + SLACK
    nx, ny = _norms(x), _norms(y)
    (px, tx, low_x, high_x), (py, ty, low_y, high_y) = _tiles(x, nx, centroids, SLICE), _tiles(y, ny, centroids, 2 * SLICE)
    x, y, nx, ny = x[px], y[py], nx[px], ny[py]
    reaches = [_single_reach(y[t], ny[t]) for t in ty]
    for i, a in enumerate(tx):
        gap = np.maximum(low_x[i] - high_y, low_y - high_x[i]).max(axis=1, initial=-np.inf)
        own = _single_reach(x[a], nx[a])
        for j in np.flatnonzero(gap <= reach):
            b = ty[j]
            yield px[a], py[b], _dots(x[a], y[b], own, reaches[j]) / (nx[a, None] * ny[None, b])


def _join_sides(left: DataFrame, right: DataFrame | None, left_id: str, vector_col: str, right_id: str, n_cells: int | None, max_rows: int | None):
    """Both sides stored and dealt by a hash of their ids into blocks, each row once for every block of the other side that it
    meets (``right`` None: each pair of blocks once), and the centroids."""
    def stored(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
        kept = write_table(rows.where(F.col(vector_col).isNotNull()).select(F.col(name).alias("_id"), F.col(vector_col).alias("_v")), "join-side")
        return kept, kept.count()

    ours, n = stored(left, left_id)
    theirs, m = (ours, n) if right is None else stored(right, right_id)
    centroids = train_cells(theirs, "_v", n_cells or max(1, min(PIVOTS, m // JOIN_ROWS)))
    tasks = GRID_CELLS * left.sparkSession.sparkContext.defaultParallelism
    side = math.isqrt(n * m // (tasks * (1 if right is not None else 2))) + 1
    rows = max_rows or min(JOIN_BLOCK, max(MAX_ROWS, side))
    bl, br = max(1, -(-n // rows)), max(1, -(-m // rows))
    block = lambda k: F.pmod(F.xxhash64("_id"), F.lit(k)).cast("int")
    ours, theirs = ours.withColumn("_l", block(bl)), theirs.withColumn("_r", block(br))
    ours = ours.withColumn("_r", F.explode(F.sequence(F.lit(0) if right is not None else F.col("_l"), F.lit(br - 1))))
    theirs = theirs.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(bl - 1) if right is not None else F.col("_r"))))
    return ours.groupBy("_l", "_r").cogroup(theirs.groupBy("_l", "_r")), centroids


def cosine_join(left: DataFrame, right: DataFrame | None, threshold: float, *, left_id: str = "left_id", right_id: str = "right_id",
                vector_col: str = "embedding", n_cells: int | None = None, max_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, work): every pair (left_id, right_id, similarity) with cosine >= threshold, and the pairs scored.

    ``right`` None joins ``left`` with itself: each unordered pair once, left_id < right_id, and no row with
    itself.  Ids name the rows.  Null vectors and those without a direction match nothing.  A row is sent once for each
    block of ``max_rows`` rows of the other side; what a cell cannot hold is left out where two blocks meet."""
    both = right is not None
    pair = T.StructType([T.StructField(left_id, left.schema[left_id].dataType), T.StructField(right_id, (right.schema[right_id] if both else left.schema[left_id]).dataType), T.StructField("similarity", T.DoubleType())])
    met, centroids = _join_sides(left, right, left_id, vector_col, right_id, n_cells, max_rows)
    if not len(centroids):
        none = left.sparkSession.createDataFrame([], pair)
        return none, none.agg(F.lit(0).cast("bigint").alias("pairs_scored"))
    out = pa.schema([*(pa.field(f.name, _arrow_type(f.dataType)) for f in pair.fields), pa.field("scored", pa.int64())])

    def meet(come: pa.Table, stay: pa.Table) -> pa.Table:
        if not len(come) or not len(stay):
            return out.empty_table()
        a, b = come["_id"].combine_chunks(), stay["_id"].combine_chunks()
        within = not both and come["_l"][0].as_py() == come["_r"][0].as_py()  # both rows are on both sides: the smaller id counts
        if within:
            ka, kb = a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)
        found, scored = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))], 0
        for i, j, s in _alike(_list_matrix(come["_v"], None, as_stored=True), _list_matrix(stay["_v"], None, as_stored=True), centroids, threshold):
            scored += s.size
            hit = s >= threshold
            if within:
                hit &= ka[i][:, None] < kb[j][None]
            p, q = np.nonzero(hit)
            if len(p):
                found.append((i[p].astype(np.int32), j[q].astype(np.int32), s[p, q]))
        p, q, s = (np.concatenate(v) for v in zip(*found, strict=True))
        cols = [pa.concat_arrays([c.take(pa.array(i)), pa.nulls(1, c.type)]) for c, i in ((a, p), (b, q))]
        return pa.Table.from_arrays([*cols, pa.array(np.append(s, np.nan)), pa.array(np.append(np.zeros(len(s), np.int64), scored))], schema=out)

    met = write_table(met.applyInArrow(meet, T.StructType([*pair.fields, T.StructField("scored", T.LongType())])), "pairs")
    pairs = met.where(F.col(left_id).isNotNull()).select(*pair.names)
    if not both:
        low, high = F.least(left_id, right_id), F.greatest(left_id, right_id)
        pairs = pairs.select(low.alias(left_id), high.alias(right_id), "similarity")
    return pairs, met.agg(F.coalesce(F.sum("scored"), F.lit(0)).alias("pairs_scored"))


def similar_ids(left: DataFrame, right: DataFrame, threshold: float, *, left_id: str = "left_id", right_id: str = "right_id",
                vector_col: str = "embedding", n_cells: int | None = None, max_rows: int | None = None) -> DataFrame:
    """The distinct ids of rows of ``left`` that have a pair in ``cosine_join``, without the pairs: a task gives each of its
    rows back once, however many rows it is similar to."""
    met, centroids = _join_sides(left, right, left_id, vector_col, right_id, n_cells, max_rows)
    schema = T.StructType([T.StructField(left_id, left.schema[left_id].dataType)])
    out = pa.schema([pa.field(left_id, _arrow_type(left.schema[left_id].dataType))])
    if not len(centroids):
        return left.sparkSession.createDataFrame([], schema)

    def meet(come: pa.Table, stay: pa.Table) -> pa.Table:
        if not len(come) or not len(stay):
            return out.empty_table()
        hit = np.zeros(len(come), bool)
        for i, _, s in _alike(_list_matrix(come["_v"], None, as_stored=True), _list_matrix(stay["_v"], None, as_stored=True), centroids, threshold):
            hit[i[(s >= threshold).any(axis=1)]] = True
        return pa.Table.from_arrays([come["_id"].combine_chunks().filter(pa.array(hit))], schema=out)

    return met.applyInArrow(meet, schema).distinct()


def search_cells(index: CellIndex, queries: DataFrame, k: int = 5, probes: int = 8, *, query_id: str = "query_id",
                 query_vector: str = "embedding", max_rows: int = MAX_ROWS, counted: bool = False,
                 max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """(query_id, rank, keys, similarity): the ``k`` nearest rows of each query's ``probes`` nearest cells, equal
    ones by key; with ``counted`` a row per query of all that were scored (query_id, scored) instead.

    Query ids name the queries.  Only the cells that are probed are read.  Queries and probe lists of up to
    ``max_broadcast_bytes`` are sent to the stored rows, which then are not shuffled; more of them meet the rows by cell."""
    centroids = index.centroids
    full = np.flatnonzero(index.rows > 0)
    probes = min(probes, len(full))
    key_fields = [index.table.schema[c] for c in index.keys]
    out_type = T.StructType([queries.schema[query_id], *key_fields, T.StructField("similarity", T.DoubleType())])
    if not probes:
        empty = queries.sparkSession.createDataFrame([], out_type)
        return empty.groupBy(query_id).agg(F.count(F.lit(1)).alias("scored")) if counted else empty.withColumn("rank", F.lit(0)).select(query_id, "rank", *index.keys, "similarity")

    def choose(u: np.ndarray, b: pa.RecordBatch):
        s = np.nan_to_num(u @ centroids.T, nan=-2.0)
        near = full[np.argsort(-s[:, full], axis=1, kind="stable")[:, :probes]]
        mask = np.zeros(s.shape, bool)
        np.put_along_axis(mask, near, ~np.isnan(u).any(axis=1)[:, None], axis=1)
        return mask, s

    own = write_table(queries.where(F.col(query_vector).isNotNull()).select(query_id, query_vector), "queries")
    schema = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in out_type.fields])
    w = Window.partitionBy(query_id).orderBy(F.desc("similarity"), *index.keys)

    def first(found: DataFrame) -> DataFrame:
        return (found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
                .select(query_id, "rank", *index.keys, "similarity"))

    if not counted and own.count() * (centroids.shape[1] * 8 + probes * 4) <= max_broadcast_bytes:
        return first(_search_sent(index, own.toArrow(), k, choose, query_id, schema, out_type))
    visits, blocks = _visits(own, query_id, query_vector, choose, index.chunks, max_rows)
    visits = write_table(visits, "probes")
    if counted:
        size = queries.sparkSession.createDataFrame([(int(i), int(index.rows[i])) for i in full], "cell int, n bigint")
        return visits.where("chunk = 0").join(F.broadcast(size), "cell").groupBy(query_id).agg(F.sum("n").alias("scored"))
    probed = [r["cell"] for r in visits.select("cell").distinct().collect()]  # at most MOST_CELLS numbers
    homes = _homes(index, blocks).where(F.col("cell").isin(probed))
    vector, keys = index.vector, index.keys

    def score(come: pa.Table, stay: pa.Table) -> pa.Table:
        if not len(come) or not len(stay):
            return schema.empty_table()
        stay = stay.sort_by([(c, "ascending") for c in keys])  # equal scores then stand in order of key
        x, y = _list_matrix(come[query_vector], None), _list_matrix(stay[vector], None)
        nx, ny = _norms(x), _norms(y)
        rows, cols, sims = [], [], []
        step = max(1, BLOCK // len(y))
        for i in range(0, len(x), step):
            s = (x[i:i + step] @ y.T) / (nx[i:i + step, None] * ny[None])
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            rows.append(np.repeat(np.arange(i, i + len(s)), best.shape[1]))
            cols.append(best.ravel())
            sims.append(np.take_along_axis(s, best, 1).ravel())
        row, col = pa.array(np.concatenate(rows)), pa.array(np.concatenate(cols))
        return pa.Table.from_arrays([come[query_id].take(row), *(stay[c].take(col) for c in keys), pa.array(np.concatenate(sims))], schema=schema)

    by = ("cell", "chunk", "block")
    return first(visits.groupBy(*by).cogroup(homes.groupBy(*by)).applyInArrow(score, out_type))


def _search_sent(index: CellIndex, queries: pa.Table, k: int, choose, query_id: str, schema: pa.Schema, out_type: T.StructType) -> DataFrame:
    """Candidates of each task's rows for the ``queries`` (id, vector), a bounded table, that ``choose`` sends to the rows' cells."""
    x = _list_matrix(queries.column(1), None)
    visitors: list[list[np.ndarray]] = [[] for _ in index.centroids]
    for i in range(0, len(x), SLICE):
        row, cell = np.nonzero(choose(unit(x[i:i + SLICE]), None)[0].T)[::-1]  # by cell
        for c, part in zip(*_runs(cell), strict=True):
            visitors[c].append((row[part] + i).astype(np.int32))
    visitors = [np.concatenate(v) if v else np.zeros(0, np.int32) for v in visitors]
    ids = queries.column(0).combine_chunks() if queries.num_rows else pa.array([], queries.schema.field(0).type)
    held = index.table.sparkSession.sparkContext.broadcast((ids, x, _norms(x), visitors))
    vector, keys, most = index.vector, list(index.keys), int(index.chunks.max())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, norms, visitors = held.value

        def candidates(batch: pa.RecordBatch, least: np.ndarray):
            y = _list_matrix(batch.column(vector), x.shape[1])
            ny, place = _norms(y), _key_order(batch, keys)
            chunk = batch.column("cell").to_numpy() * most + batch.column("chunk").to_numpy()
            order = np.argsort(chunk, kind="stable")
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for c, part in zip(*_runs(chunk[order]), strict=True):  # of equal scores a chunk gives rows without a key last
                q, rows = visitors[c // most], order[part]
                if len(q):
                    qi, ri, sims = _block_candidates(x[q], norms[q], y[rows], ny[rows], place[rows], k, least[q])
                    _raise_least(least, q[qi], sims, k)
                    found.append((q[qi], rows[ri], sims))
            return tuple(np.concatenate(f) for f in zip(*found, strict=True))

        yield from _keep_best(batches, candidates, ids, k, vector, query_id, keys, schema, "at_start")

    probed = [i for i, v in enumerate(visitors) if len(v)]  # at most MOST_CELLS numbers
    return index.table.where(F.col("cell").isin(probed)).select(*keys, vector, F.col("cell").cast("long").alias("cell"), "chunk").mapInArrow(score, out_type)


def _runs(cell: np.ndarray) -> tuple[list[int], list[slice]]:
    """The distinct numbers of a sorted array, and where each stands."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    return cell[starts].tolist(), [slice(a, b) for a, b in zip(starts, [*starts[1:], len(cell)], strict=True)]


def calibrated_probes(index: CellIndex, queries: DataFrame, recall: float = 0.95, k: int = 5, sample: int = 200, *,
                      query_id: str = "query_id", query_vector: str = "embedding") -> int:
    """The shortest probe list that finds ``recall`` of the true ``k`` nearest of ``sample`` queries (those of least
    hash), all of whose neighbours are found by one scan of the stored cells."""
    drawn = (queries.where(F.col(query_vector).isNotNull()).withColumn("_h", F.xxhash64(query_id)).orderBy("_h").limit(sample).select(query_id, query_vector))
    q = drawn.toArrow()  # the bounded sample
    if not q.num_rows or not (index.rows > 0).any():
        return 1
    u = unit(_list_matrix(q.column(1), None))
    asked = queries.sparkSession.createDataFrame(pa.table({"q": pa.array(range(q.num_rows)), index.vector: q.column(1)}))
    true = vector_topk(index.table, asked, k, key_cols=(*index.keys, "cell"), payload_cols=(), vector_col=index.vector,
                       query_id="q", query_vector=index.vector)
    full = np.flatnonzero(index.rows > 0)
    place = np.full((len(u), len(index.centroids)), len(full))
    near = full[np.argsort(-np.nan_to_num(u @ index.centroids.T, nan=-2.0)[:, full], axis=1, kind="stable")]
    np.put_along_axis(place, near, np.broadcast_to(np.arange(len(full)), near.shape), axis=1)
    needed = np.sort([place[r["q"], r["cell"]] for r in true.collect()])  # k rows a sampled query
    return int(needed[min(len(needed) - 1, max(0, math.ceil(recall * len(needed)) - 1))]) + 1 if len(needed) else 1
