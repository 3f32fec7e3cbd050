"""Approximate nearest neighbours on robust-pruned directed graphs, one a shard.

Vectors are dealt to shards of about ``SHARD`` rows.  A shard scales its vectors to length one,
collapses equal ones and builds a graph: greedy beam searches from the most central vector
propose neighbours, and a candidate is kept only if no neighbour kept before is closer to it by
a factor of ``alpha``, which leaves edges in diverse directions.  Queries visit every shard in
blocks; a beam search proposes candidates, whose cosines are then taken exactly, in double
precision, on the original vectors.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir, write_table

#: Rows of a shard and of a query block (about as many bytes as a shard's graph) on average; edges of a vector;
#: beam while building and while searching.
SHARD, QUERIES, DEGREE, BEAM, SEARCH_BEAM = 4096, 4096, 32, 64, 96
ALPHA = 1.2
_BATCH = 256


def _search(x: np.ndarray, edges: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search for every row of q: (nodes, squared distances), nearest first; -1 pads."""
    m, n, degree = len(q), len(x), edges.shape[1]
    rows = np.arange(m)
    node = np.full((m, beam), -1, np.int32)
    dist = np.full((m, beam), np.inf, np.float32)
    done = np.ones((m, beam), bool)
    node[:, 0], done[:, 0] = start, False
    dist[:, 0] = ((q - x[start]) ** 2).sum(axis=1)
    met = np.zeros((m, n), bool)
    met[:, start] = True
    while len(rows):
        todo = np.where(done[rows], np.inf, dist[rows])
        best = todo.argmin(axis=1)
        live = np.isfinite(todo[np.arange(len(rows)), best])
        rows, best = rows[live], best[live]
        if not len(rows):
            break
        done[rows, best] = True
        cand = edges[node[rows, best]]
        fresh = (cand >= 0) & ~met[rows[:, None], np.maximum(cand, 0)]
        r, c = np.nonzero(fresh)
        met[rows[r], cand[r, c]] = True
        d = np.full(cand.shape, np.inf, np.float32)
        diff = x[cand[r, c]] - q[rows[r]]
        d[r, c] = np.einsum("ij,ij->i", diff, diff)
        d_all = np.concatenate([dist[rows], d], axis=1)
        n_all = np.concatenate([node[rows], np.where(fresh, cand, -1)], axis=1)
        f_all = np.concatenate([done[rows], ~fresh], axis=1)
        pick = np.argpartition(d_all, beam - 1, axis=1)[:, :beam]
        at = np.arange(len(rows))[:, None]
        dist[rows], node[rows], done[rows] = d_all[at, pick], n_all[at, pick], f_all[at, pick]
    order = np.argsort(dist, axis=1, kind="stable")
    at = np.arange(m)[:, None]
    return np.where(np.isfinite(dist[at, order]), node[at, order], -1), dist[at, order]


def robust_prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each of ``own``: up to ``degree`` of its candidates (rows of ``cand``, -1 pads), nearest
    first; one kept drops those that lie nearer to it, by ``alpha``, than to the vector itself."""
    cand = np.where(cand == own[:, None], -1, cand)
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    v = x[np.maximum(cand, 0)]
    d = ((v - x[own][:, None]) ** 2).sum(axis=2)
    d[cand < 0] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    at = np.arange(len(own))[:, None]
    cand, d, v = cand[at, order], d[at, order], v[at, order]
    near = np.einsum("rid,rid->ri", v, v)
    near = near[:, :, None] + near[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    live, out = np.isfinite(d), np.full((len(own), degree), -1, np.int32)
    each = np.arange(len(own))
    for k in range(degree):
        best = live.argmax(axis=1)
        some = live[each, best]
        if not some.any():
            break
        out[some, k] = cand[each[some], best[some]]
        live &= ~(some[:, None] & (alpha * alpha * near[each, best] <= d))
        live[each, best] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(edges, start) over unit vectors: two passes, the first with alpha 1."""
    n = len(x)
    degree = max(1, min(degree, n - 1))
    start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    rng = np.random.default_rng(n)
    edges = rng.integers(0, n, (n, degree), dtype=np.int32) if n > 1 else np.full((1, 1), -1, np.int32)
    if n == 1:
        return edges, 0
    for slack in (1.0, alpha):
        order = rng.permutation(n)
        for at in range(0, n, _BATCH):
            own = order[at:at + _BATCH]
            found, _ = _search(x, edges, start, x[own], beam)
            edges[own] = robust_prune(x, own, np.concatenate([found, edges[own]], axis=1), degree, slack)
            # Edges back, and a new pruning of those that receive them.
            to, frm = edges[own].ravel(), np.repeat(own, degree)
            to, frm = to[to >= 0], frm[to >= 0]
            sort = np.argsort(to, kind="stable")
            to, frm = to[sort], frm[sort]
            heads, first, many = np.unique(to, return_index=True, return_counts=True)
            for lo in range(0, len(heads), _BATCH):
                h, m = heads[lo:lo + _BATCH], many[lo:lo + _BATCH]
                extra = np.full((len(h), int(m.max())), -1, np.int32)
                r = np.repeat(np.arange(len(h)), m)
                k = np.arange(len(r)) - np.repeat(np.cumsum(m) - m, m)
                extra[r, k] = frm[np.repeat(first[lo:lo + _BATCH], m) + k]
                edges[h] = robust_prune(x, h, np.concatenate([edges[h], extra], axis=1), degree, slack)
    return edges, start


def _bytes(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, vec (array<double>) and dim of the rows that can be compared: id and vector not null, every
    component finite, not all zero."""
    v = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vec", lambda c: c != 0)
    return v.where("id IS NOT NULL AND vec IS NOT NULL").where(fine).withColumn("dim", F.size("vec"))


def build_index(rows: DataFrame, shard_rows: int = SHARD, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> DataFrame:
    """One row a shard (dim, shard, graph) over ``usable`` rows; every row is in exactly one.

    Equal vectors of a shard share a node; the node lists their ids, smallest first."""
    sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}  # one row a dimension
    if not sizes:
        return rows.sparkSession.createDataFrame([], "dim int, shard int, graph binary")
    many = {d: max(1, -(-n // shard_rows)) for d, n in sorted(sizes.items())}
    before = {d: sum(m for e, m in many.items() if e < d) for d in many}
    of = lambda numbers: F.create_map(*[F.lit(x) for item in numbers.items() for x in item])[F.col("dim")]
    # Rows of a repeated id are dealt by their vectors too.
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "vec"), of(many)).cast("int")).withColumn("cell", of(before) + F.col("shard"))

    def build(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        vec = table["vec"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        ids, vec = ids[order], vec[order]
        _, first, node = np.unique(vec.view(np.dtype((np.void, vec.dtype.itemsize * vec.shape[1]))).ravel(), return_index=True, return_inverse=True)
        by_node = np.argsort(node, kind="stable")
        own = vec[first]
        unit = own / np.abs(own).max(axis=1, keepdims=True)  # no square overflows
        unit = (unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))).astype(np.float32)
        edges, start = build_graph(unit, degree, beam, alpha)
        graph = _bytes(unit=unit, own=own, edges=edges, start=np.array(start), ids=ids[by_node], at=np.searchsorted(node[by_node], np.arange(len(first) + 1)))
        return pa.table({"dim": table["dim"][:1], "shard": table["shard"][:1], "graph": [graph]})

    # Bytes do not show the work of a shard: each has a partition of its own, by number and not by hash.
    return dealt.repartitionById(sum(many.values()), "cell").groupBy("cell").applyInArrow(build, "dim int, shard int, graph binary")


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision.  Powers of two scale each row to components of at most 1, exactly, so
    that no square overflows or vanishes."""
    a, b = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]) if v.size else v for v in (a, b))
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def search_index(index: DataFrame, queries: DataFrame, k: int = 5, beam: int = SEARCH_BEAM, block_rows: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found, ties to the smaller vec_id, the
    query's own id left out.  ``queries`` are ``usable`` rows; they meet shards of their dimension."""
    n = queries.count()
    blocks = max(1, -(-n // block_rows))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    cells = dealt.select("dim", "block").distinct().join(index.select("dim", "shard"), "dim")
    def cell() -> DataFrame:  # fresh column identities for either side
        return cells.select(*[F.col(c).alias(c) for c in ("dim", "block", "shard")])

    left = index.join(cell(), ["dim", "shard"])
    right = dealt.join(cell(), ["dim", "block"]).select(*[F.col(c).alias(c) for c in ("dim", "shard", "block", "id", "vec")])

    def search(key: tuple, shard: pa.Table, block: pa.Table) -> pa.Table:
        empty = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not len(shard) or not len(block):
            return pa.table(empty)
        g = np.load(io.BytesIO(shard["graph"][0].as_py()))
        unit, own, edges, ids, at = (g[c] for c in ("unit", "own", "edges", "ids", "at"))
        qid = block["id"].to_numpy()
        q = block["vec"].combine_chunks().flatten().to_numpy().reshape(len(qid), -1)
        scaled = q / np.abs(q).max(axis=1, keepdims=True)
        scaled = (scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))).astype(np.float32)
        found, _ = _search(unit, edges, int(g["start"]), scaled, max(beam, k + 1))
        r, c = np.nonzero(found >= 0)
        node = found[r, c]
        score = cosine(q[r], own[node])
        # The k + 1 smallest ids of a node are enough: one may be the query's own.
        many = np.minimum(at[node + 1] - at[node], k + 1)
        row = np.repeat(np.arange(len(r)), many)
        vec = ids[at[node][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]
        r, score = r[row], score[row]
        other = vec != qid[r]
        r, vec, score = r[other], vec[other], score[other]
        order = np.lexsort((vec, -score, r))
        r, vec, score = r[order], vec[order], score[order]
        first = np.searchsorted(r, np.arange(len(qid)))
        top = np.arange(len(r)) - first[r] < k
        return pa.table({"query_id": qid[r[top]], "vec_id": vec[top], "score": score[top]})

    found = (left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block"))
             .applyInArrow(search, "query_id bigint, vec_id bigint, score double"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, query_rows, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
            shard_rows: int = SHARD, beam: int = SEARCH_BEAM) -> DataFrame:
    """The k nearest other rows by cosine of the rows for which ``query_rows`` (a condition on
    ``id``) holds.  Rows whose vector is null, zero or holds null or non-finite components take no
    part; vectors of different dimensions are not compared; an empty table gives an empty result;
    of repeated ids each row is a candidate for the others' queries.  Other columns are not read."""
    checkpoint_dir(vectors.sparkSession)
    rows = write_table(usable(vectors, id_col, vec_col), "vectors")
    index = write_table(build_index(rows, shard_rows), "ann-index")
    return search_index(index, rows.where(query_rows), k, beam)
