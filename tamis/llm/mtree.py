"""Exact top-k inner products by best-first search in M-trees (operator 7).

Method. Components become integers floor(scale * x). One coordinate more, sqrt(M - |x|^2)
with M the largest squared norm, puts all rows on a sphere, where a larger inner product with
a query is a smaller distance to it, so a metric tree answers it exactly.

The tree. The root's routing objects are at most ``cells`` rows (those with the smallest
hashes); each row belongs to the nearest one, and a cell of more than ``subtree_rows`` rows
(a cluster, copies) is split by a hash into subtrees of that size. A subtree has pages of
``page_rows`` entries; a page keeps its routing object, its covering radius, the distance to
the subtree's centre, and each entry's distance to the routing object (the parent distance).

The search. First each query searches the cell it falls in, which gives the score it has to
beat; then the cells whose bound (distance to the routing object less the covering radius)
can beat it. In a subtree, pages are opened best bound first until none can beat the k-th
score so far. The triangle inequality on stored distances leaves out page distances and
entries without computing them. What is computed is the integer inner product itself: M bounds
every product and partial sum, so double precision is exact for M below 2^53, 64-bit integers up
to 2^62, and Python's integers are used beyond. A subtree passes on only what reaches the score
to beat. Bounds are loosened by a relative 1e-7, far above rounding, and ties are kept, so results
are exact. From M = 2^51 on, distances are no longer exact enough for that, and nothing is left out.

Queries come in blocks of ``query_rows``; rows meet each block in their subtree. In many
dimensions with weak structure bounds exclude little, and the work is that of comparing all
queries with all rows; it is spread evenly and never leaves a task larger than a subtree and a block.

Edge cases. Null vectors and those with a null or non-finite component take no part; zero
vectors do. Vectors of different lengths are filled with zeros. Ties go to the smaller
vec_id; copies are rows of their own, also under one vec_id; rows of the query's own vec_id are no
candidates, and a query_id of several rows has the k best of all of them. Null ids take no part. With fewer than k candidates all are returned. A score beyond
64 bits, or a component that scaling makes infinite, is an error that names the vectors. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tamis.llm.frames import materialize, ship
from tamis.llm.vectors import best, blobs, matrix, unblob, vector_rows

_EPS = 1e-7
_PRUNED = 2.0 ** 51  # largest squared norm from which on distances leave nothing out


def quantise(x: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(scale * x)


def _reach(norm: float, top: float, score: float) -> float:
    """The distance within which rows reach the score, for a query of that squared norm."""
    return np.inf if top >= _PRUNED else float(np.sqrt(max(norm + top - 2.0 * score, 0.0))) * (1 + _EPS) + 1e-6


def _integers(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0.0))


def _distances(x, hx, q, hq) -> np.ndarray:
    """Distances between lifted rows and one lifted point."""
    d = x - q
    return np.sqrt(np.maximum((d * d).sum(axis=1) + (hx - hq) ** 2, 0.0))


class Subtree:
    """Pages of entries with covering radii and parent distances."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, top: float, page_rows: int):
        self.top = top
        self.as_numbers = (lambda a: a) if top < 2.0 ** 53 else (lambda a: a.astype(np.int64)) if top < 2.0 ** 62 else _integers
        if top >= _PRUNED:  # one page after the other
            self.pages = [(0, ids[a:a + page_rows], self.as_numbers(x[a:a + page_rows]), None, np.inf) for a in range(0, len(ids), page_rows)]
            return
        h = _lift(x, top)
        n = len(ids)
        pages = max(1, -(-n // page_rows))
        centers = np.argsort((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")[:pages]
        near = np.zeros(n, dtype=np.int64)
        least = np.full(n, np.inf)
        for j, c in enumerate(centers):
            d = _distances(x, h, x[c], h[c])
            hit = d < least
            near[hit], least[hit] = j, d[hit]
        order = np.lexsort((least, near))
        cut = np.flatnonzero(np.diff(near[order])) + 1
        self.pages = []
        for part in np.split(order, cut):
            for a in range(0, len(part), 2 * page_rows):  # a page of many near entries is cut
                e = part[a:a + 2 * page_rows]
                c = centers[near[e[0]]]
                self.pages.append((c, ids[e], np.ascontiguousarray(x[e]), least[e], float(least[e].max())))
        c = np.array([p[0] for p in self.pages])
        self.cx, self.ch = x[c], h[c]
        self.radius = np.array([p[4] for p in self.pages])
        self.rx, self.rh = x.mean(axis=0), float(h.mean())
        self.to_root = _distances(self.cx, self.ch, self.rx, self.rh)

    def search(self, qid: int, q: np.ndarray, k: int, floor: float | None):
        """(ids, scores) of the k best that reach ``floor``, the score to beat."""
        if self.top >= _PRUNED:
            return self._search_all(qid, self.as_numbers(q), k, floor)
        norm = float((q * q).sum())
        reach = lambda s: _reach(norm, self.top, s)
        far = np.inf if floor is None else reach(floor)
        root = float(np.sqrt(((q - self.rx) ** 2).sum() + self.rh ** 2))
        slack = (1 + _EPS)
        may = np.flatnonzero(np.abs(root - self.to_root) - self.radius * slack - 1e-6 * (1 + root) <= far)
        if not len(may):
            return np.zeros(0, np.int64), np.zeros(0)
        d = np.sqrt(((self.cx[may] - q) ** 2).sum(axis=1) + self.ch[may] ** 2)
        queue = list(zip((d - self.radius[may] * slack - 1e-6 * (1 + d)).tolist(), may.tolist(), d.tolist()))
        heapq.heapify(queue)
        ids, scores, least = np.zeros(0, np.int64), np.zeros(0), floor
        while queue:
            bound, p, dp = heapq.heappop(queue)
            if bound > far:
                break
            _, pid, px, pd, _ = self.pages[p]
            if far < np.inf:
                some = np.abs(dp - pd) <= far + 1e-6 * (1 + dp)
                if not some.all():
                    pid, px = pid[some], px[some]
            s = px @ q
            ok = pid != qid
            if least is not None:
                ok &= s >= least
            if not ok.any():
                continue
            ids, scores = np.concatenate([ids, pid[ok]]), np.concatenate([scores, s[ok]])
            if len(ids) > k:
                order = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[order], scores[order]
            if len(ids) >= k and (least is None or scores.min() > least):
                least = scores.min()
                far = reach(float(least))
        return ids, scores

    def _search_all(self, qid: int, q: np.ndarray, k: int, floor: int | None):
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, pid, px, _, _ in self.pages:
            some = pid != qid
            pid, s = pid[some], (px @ q)[some]
            for i, v in zip(pid.tolist(), s.tolist()):
                if not -2 ** 63 <= v < 2 ** 63:
                    raise OverflowError(f"the inner product of vec_id {qid} and vec_id {i} is beyond 64 bits")
            s = s.astype(np.int64)
            if floor is not None:
                pid, s = pid[s >= floor], s[s >= floor]
            ids, scores = np.concatenate([ids, pid]), np.concatenate([scores, s])
            order = np.lexsort((ids, ~scores))[:k]
            ids, scores = ids[order], scores[order]
        return ids, scores


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_FOUND_SQL = "query_id long, vec_id long, score long"


def _assign(dim: int, scale: float, top: float, pivots: np.ndarray):
    """Each row's integers, cell and distance to the cell's routing object."""
    ph = _lift(pivots, top) if top < _PRUNED else None

    def run(batches):
        for b in batches:
            x = quantise(matrix(b.column("vec"), dim), scale)
            bad = np.flatnonzero(~np.isfinite(x).all(axis=1))
            if len(bad):
                raise OverflowError(f"vec_id {b.column('vec_id')[int(bad[0])].as_py()} has a component that is infinite after scaling")
            near, least = np.zeros(len(x), dtype=np.int32), np.full(len(x), np.inf)
            h = _lift(x, top) if top < _PRUNED else None
            if top >= _PRUNED:  # any cell will do
                near[:] = b.column("vec_id").to_numpy() % len(pivots)
            for j in range(len(pivots) if top < _PRUNED else 0):
                d = _distances(x, h, pivots[j], ph[j])
                hit = d < least
                near[hit], least[hit] = j, d[hit]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), blobs(x), pa.array(near), pa.array(least)], names=["vec_id", "x", "cell", "dist"])
    return run


def _targets(dim: int, top: float, pivots: np.ndarray, radius: dict[int, float], first: bool):
    """The cells a query goes to: its own (first), or all others that may beat its k-th score."""
    ph = _lift(pivots, top) if top < _PRUNED else None
    cells = np.array(sorted(radius), dtype=np.int32)
    r = np.array([radius[c] for c in cells.tolist()])

    def run(batches):
        for b in batches:
            q = unblob(b.column("x"), dim)
            floors = b.column("floor").to_pylist()
            rows = []
            for i in range(len(q)):
                if top >= _PRUNED:
                    rows.append(cells[:1].tolist() if first else cells[1:].tolist())
                    continue
                d = np.sqrt(((pivots[cells] - q[i]) ** 2).sum(axis=1) + ph[cells] ** 2)
                own = int(cells[int(np.argmin(d))])
                if first:
                    rows.append([own])
                    continue
                far = np.inf if floors[i] is None else _reach(float((q[i] ** 2).sum()), top, floors[i])
                rows.append(cells[(d - r * (1 + _EPS) - 1e-6 * (1 + d) <= far) & (cells != own)].tolist())
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("x"), b.column("floor"), pa.array(rows, pa.list_(pa.int32()))],
                                             names=["query_id", "x", "floor", "cells"])
    return run


def _visit(dim: int, top: float, page_rows: int, k: int):
    def run(key, left, right):
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        tree = Subtree(left.column("vec_id").to_numpy(), unblob(left.column("x"), dim), top, page_rows)
        qs, out = unblob(right.column("x"), dim), []
        for qid, q, floor in zip(right.column("query_id").to_pylist(), qs, right.column("floor").to_pylist()):
            ids, s = tree.search(qid, q, k, floor)
            out.append((np.full(len(ids), qid), ids, s.astype(np.int64)))
        return pa.Table.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), _FOUND.types)], schema=_FOUND)
    return run


def top_inner_products(df: DataFrame, is_query, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0, k: int = 20,
                       cells: int = 64, subtree_rows: int = 4096, page_rows: int = 128, query_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of every row with ``is_query(id)``."""
    spark = df.sparkSession
    ship(spark)
    rows, n, _, dim = vector_rows(df, id_col, vec_col, nonzero=False)
    dim = max(dim, 1)
    if not n:
        return best(spark.createDataFrame([], _FOUND_SQL), k)
    whole = lambda x: F.floor(x * scale).cast("double")  # noqa: E731  (a long; at its bounds the norm is far beyond 2^62)
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + whole(x) * whole(x))
    top = float(rows.agg(F.max(norm)).first()[0])
    wanted = min(cells, max(1, -(-n // subtree_rows)))
    sample = rows.orderBy(F.xxhash64(F.lit(9), "vec_id"), "vec_id").limit(wanted).toArrow()  # routing objects, at most ``cells``
    pivots = quantise(matrix(sample.column("vec"), dim), scale)
    put = rows.mapInArrow(_assign(dim, scale, top, pivots), "vec_id long, x binary, cell int, dist double")
    put = materialize(spark, put.withColumn("row", F.monotonically_increasing_id()), "cells")
    about = put.groupBy("cell").agg(F.max("dist").alias("r"), F.count(F.lit(1)).alias("n")).collect()  # at most ``cells`` rows
    radius = {r.cell: r.r for r in about}
    parts = F.create_map(*[F.lit(v) for r in about for v in (r.cell, -(-r.n // subtree_rows))])
    queries = put.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "x")
    n_blocks = max(1, -(-queries.count() // query_rows))
    trees = put.select("cell", F.pmod(F.xxhash64(F.lit(4), "vec_id", "row"), parts[F.col("cell")]).cast("int").alias("part"),
                       F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "vec_id", "x")

    def visit(asked: DataFrame, first: bool) -> DataFrame:
        to = asked.mapInArrow(_targets(dim, top, pivots, radius, first), "query_id long, x binary, floor long, cells array<int>")
        to = to.select("query_id", "x", "floor", F.explode("cells").alias("cell"))
        to = to.select("cell", F.explode(F.sequence(F.lit(0), parts[F.col("cell")].cast("int") - 1)).alias("part"),
                       F.pmod(F.xxhash64(F.lit(6), "query_id"), F.lit(n_blocks)).cast("int").alias("block"), "query_id", "x", "floor")
        key = ["cell", "part", "block"]
        return trees.groupBy(*key).cogroup(to.groupBy(*key)).applyInArrow(_visit(dim, top, page_rows, k), _FOUND_SQL)

    near = materialize(spark, best(visit(queries.withColumn("floor", F.lit(None).cast("long")), True), k), "near")
    floors = near.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = visit(queries.join(floors, "query_id", "left"), False)
    return best(near.select("query_id", "vec_id", "score").unionByName(rest), k)


def mtree_search(embeddings: DataFrame, **how) -> DataFrame:
    return top_inner_products(embeddings, lambda i: i % 20 == 0, **how)
