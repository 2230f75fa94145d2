"""Centroid clustering over a vector approximation file (operator 12).

Method. Every vector is kept twice: in full, and as ``bits`` bits per dimension naming the cell it
lies in (cell borders are quantiles per dimension). For given centroids, lookup tables hold the least and
the largest squared difference between a centroid's component and any value of a cell; their sums over
the dimensions bound a vector's distance to each centroid. A centroid whose lower bound exceeds the
least upper bound cannot be nearest. Where one centroid is left the vector is assigned from its
approximation; full vectors are fetched only where intervals overlap, and of vectors whose cluster
changed, because the componentwise sums are kept up to date by what enters and leaves a cluster.

Passes. The first assignment happens while the approximations are built, and the last one while
distances are computed, since both read the full vectors anyway (intervals still decide which centroids
are compared). The rounds between read the approximation file, a few bits per component, and
fetch by an equi-join on row numbers, which Spark broadcasts when few rows are asked for. Sums leave a
task as one row per cluster. Everything is written to the shared folder between passes; the driver holds
``k`` centroids, their sums and a bounded sample.

Integers. A component x counts as floor(64 * x); distances, sums and means are exact integers. A
component beyond 2^27 after scaling would not leave room for exact 64-bit distances: the query then ends
with an error that names the vector (its distance need not fit the result's type).

Sample. Cell borders are quantiles of at most ``sample`` vectors (those with the smallest hashes): they
change how many vectors are fetched, never a result. All vectors are approximated and clustered.

Edge cases. Vectors that are null, of another length, or hold null or non-finite components are
left out. Rows that repeat a vec_id are vectors of their own. A null vec_id takes part (its hash
orders last). Fewer vectors than ``k`` give fewer centroids; none give an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tamis.llm.frames import materialize, ship
from tamis.llm.vectors import matrix, usable

_LIMIT = 1 << 27


def _quantised(x: np.ndarray, ids) -> np.ndarray:
    q = np.floor(64.0 * x)
    big = np.flatnonzero((np.abs(q) > _LIMIT).any(axis=1))
    if len(big):
        raise ValueError(f"vec_id {ids[int(big[0])].as_py()}: a component is too large for exact 64-bit distances")
    return q.astype("<i4")


def _full(dim: int):
    """The full vectors, floor(64 x) as 32-bit integers."""
    def run(batches):
        for b in batches:
            q = _quantised(matrix(b.column("vec"), dim), b.column("vec_id"))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), pa.array([r.tobytes() for r in q], pa.binary())], names=["row", "vec_id", "q"])
    return run


def _unpack(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(-1, dim).astype(np.int64)


def _extent(dim: int):
    """One row per task and dimension: the least and the largest component."""
    def run(batches):
        lo = hi = None
        for b in batches:
            if not b.num_rows:
                continue
            q = _unpack(b.column("q"), dim)
            lo = q.min(axis=0) if lo is None else np.minimum(lo, q.min(axis=0))
            hi = q.max(axis=0) if hi is None else np.maximum(hi, q.max(axis=0))
        if lo is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["d", "lo", "hi"])
    return run


class Cells:
    """Cell borders of every dimension: cell j holds the integers from first[d, j] to last[d, j]."""

    def __init__(self, sample: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: int):
        self.bits, self.n = bits, 1 << bits
        inner = np.quantile(sample, np.arange(1, self.n) / self.n, axis=0, method="lower").T.astype(np.int64)  # (dim, n - 1)
        self.starts = np.clip(inner, lo[:, None], hi[:, None])
        self.first = np.concatenate([lo[:, None], self.starts], axis=1)
        self.last = np.maximum(np.concatenate([self.starts - 1, hi[:, None]], axis=1), self.first)

    def of(self, q: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(s, q[:, d], side="right") for d, s in enumerate(self.starts)], axis=1).astype(np.uint8)

    def pack(self, cells: np.ndarray) -> list[bytes]:
        bit = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - self.bits:]
        return [r.tobytes() for r in np.packbits(bit.reshape(len(cells), -1), axis=1)]

    def unpack(self, blobs: list[bytes], dim: int) -> np.ndarray:
        raw = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(len(blobs), -1)
        bit = np.unpackbits(raw, axis=1)[:, :dim * self.bits].reshape(len(blobs), dim, self.bits)
        return (bit << np.arange(self.bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(dim, cells, k) tables of the least and largest squared difference."""
        c = centroids.T[:, None, :]                       # (dim, 1, k)
        a, b = self.first[:, :, None], self.last[:, :, None]
        low = np.maximum(np.maximum(a - c, c - b), 0)
        high = np.maximum(np.abs(a - c), np.abs(b - c))
        return low * low, high * high


def candidates(cells: np.ndarray, tables) -> np.ndarray:
    """Which centroids' distance intervals reach below the least upper bound (rows x k)."""
    low, high = tables
    least = np.zeros((len(cells), low.shape[2]), dtype=np.int64)
    most = np.zeros_like(least)
    for d in range(cells.shape[1]):
        least += low[d][cells[:, d]]
        most += high[d][cells[:, d]]
    return least <= most.min(axis=1, keepdims=True)


def nearest(q: np.ndarray, cand: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest candidate of each vector (ties: the smaller number) and its squared distance."""
    dist = np.full(cand.shape, np.iinfo(np.int64).max)
    r, c = np.nonzero(cand)
    for i in range(0, len(r), 65_536):
        a, b = r[i:i + 65_536], c[i:i + 65_536]
        diff = q[a] - centroids[b]
        dist[a, b] = (diff * diff).sum(axis=1)
    at = dist.argmin(axis=1)
    return at, dist[np.arange(len(q)), at]


#: Rows of a pass: of a vector (cluster < 0: undecided), or, with a null row, a task's change of a cluster's sums.
_PASS_SQL = "row long, cells binary, cluster int, old int, cand binary, moved array<long>, moved_n long"
_PASS = pa.schema([("row", pa.int64()), ("cells", pa.binary()), ("cluster", pa.int32()), ("old", pa.int32()), ("cand", pa.binary()),
                   ("moved", pa.list_(pa.int64())), ("moved_n", pa.int64())])


def _vectors(row, cells, cluster, old, cand) -> pa.RecordBatch:
    n = len(row)
    nothing = [None] * n
    cols = [row, cells or nothing, pa.array(cluster, pa.int32()), nothing if old is None else pa.array(old, pa.int32()), cand or nothing, nothing, nothing]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, _PASS.types)], schema=_PASS)


def _sums(total: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    at = [i for i in range(len(count)) if count[i] or total[i].any()]
    cols = [[None] * len(at), [None] * len(at), at, [None] * len(at), [None] * len(at), [total[i].tolist() for i in at], [int(count[i]) for i in at]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _PASS.types)], schema=_PASS)


def _build(cells: Cells, centroids: np.ndarray):
    """Approximations, the first assignment and its sums, in one pass over the full vectors."""
    k, dim = centroids.shape

    def run(batches):
        tables = cells.tables(centroids)
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            q = _unpack(b.column("q"), dim)
            c = cells.of(q)
            at, _ = nearest(q, candidates(c, tables), centroids)
            np.add.at(total, at, q)
            count += np.bincount(at, minlength=k)
            yield _vectors(b.column("row"), cells.pack(c), at, None, None)
        yield _sums(total, count)
    return run


def _decide(cells: Cells, centroids: np.ndarray):
    """From approximations alone: the new cluster, or the centroids whose intervals overlap."""
    k, dim = centroids.shape

    def run(batches):
        tables = cells.tables(centroids)
        for b in batches:
            if not b.num_rows:
                continue
            blobs = b.column("cells").to_pylist()
            cand = candidates(cells.unpack(blobs, dim), tables)
            one = cand.sum(axis=1) == 1
            cluster = np.where(one, cand.argmax(axis=1), -1)
            masks = [None if o else m.tobytes() for o, m in zip(one.tolist(), np.packbits(cand, axis=1))]
            yield _vectors(b.column("row"), blobs, cluster, b.column("cluster").to_numpy(), masks)
    return run


def _resolve(centroids: np.ndarray):
    """Fetched vectors: undecided ones are compared with their candidates; sums move with changed ones."""
    k, dim = centroids.shape

    def run(batches):
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            q, old, at = _unpack(b.column("q"), dim), b.column("old").to_numpy(), b.column("cluster").to_numpy().copy()
            open_ = np.flatnonzero(at < 0)
            if len(open_):
                raw = b.column("cand").take(pa.array(open_)).to_pylist()
                cand = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(len(open_), -1), axis=1)[:, :k].astype(bool)
                at[open_] = nearest(q[open_], cand, centroids)[0]
                yield _vectors(b.column("row").take(pa.array(open_)), None, at[open_], None, None)
            moved = at != old
            np.add.at(total, at[moved], q[moved])
            np.subtract.at(total, old[moved], q[moved])
            count += np.bincount(at[moved], minlength=k) - np.bincount(old[moved], minlength=k)
        yield _sums(total, count)
    return run


def _finish(cells: Cells, centroids: np.ndarray):
    """The last assignment with exact distances (the full vectors are read for those)."""
    dim = centroids.shape[1]

    def run(batches):
        tables = cells.tables(centroids)
        for b in batches:
            if not b.num_rows:
                continue
            q = _unpack(b.column("q"), dim)
            at, dist = nearest(q, candidates(cells.of(q), tables), centroids)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(at, pa.int32()), pa.array(dist, pa.int64())], names=["vec_id", "cluster", "distance"])
    return run


def _moved(passed: DataFrame) -> list:
    """Per cluster: (cluster, dimension sums, count) of what entered less what left; k rows reach the driver."""
    flat = passed.where("row is null").select("cluster", "moved_n", F.posexplode("moved").alias("d", "s"))
    per = flat.groupBy("cluster", "d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("moved_n").alias("n"))
    return per.groupBy("cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("d", "s"))).alias("s")).collect()


def cluster_vectors(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3, dim: int = 64,
                    bits: int = 4, sample: int = 4096, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance of every vector; the final centroids). ``rounds`` of assignment and update, then a last assignment.

    The starting centroids are the ``k`` vectors with the smallest lowercase-hex sha256 of ``<seed>:<vec_id>``.
    """
    if not 1 <= bits <= 8:
        raise ValueError("bits must be 1 to 8")
    spark = df.sparkSession
    ship(spark)
    vec = F.col("vec")
    rows = df.select(df["`" + id_col + "`"].cast("long").alias("vec_id"), df["`" + vec_col + "`"].cast("array<double>").alias("vec"))
    rows = rows.where(F.coalesce((F.size(vec) == dim) & usable(vec, False), F.lit(False)))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    full = materialize(spark, numbered.mapInArrow(_full(dim), "row long, vec_id long, q binary"), "vectors")
    out_sql = "vec_id long, cluster int, distance long"
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = full.orderBy(key.asc_nulls_last(), "q").limit(k).select("q").collect()
    if not first:
        return spark.createDataFrame([], out_sql), []
    ints = lambda found: np.frombuffer(b"".join(bytes(r.q) for r in found), dtype="<i4").reshape(-1, dim).astype(np.int64)
    centroids = ints(first)
    seen = ints(full.orderBy(F.xxhash64("vec_id", "row")).limit(sample).select("q").collect())
    ext = {r.d: (r.lo, r.hi) for r in full.mapInArrow(_extent(dim), "d int, lo long, hi long").groupBy("d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
    cells = Cells(seen, np.array([ext[d][0] for d in range(dim)]), np.array([ext[d][1] for d in range(dim)]), bits)
    total, count = [[0] * dim for _ in centroids], [0] * len(centroids)

    def update(passed: DataFrame) -> np.ndarray:
        for r in _moved(passed):
            count[r.cluster] += r.n
            total[r.cluster] = [a + int(x.s) for a, x in zip(total[r.cluster], r.s)]
        return np.array([[s // n for s in t] if n else c for t, n, c in zip(total, count, centroids.tolist())], dtype=np.int64)

    state = None
    for number in range(rounds):
        if state is None:
            passed = materialize(spark, full.mapInArrow(_build(cells, centroids), _PASS_SQL), "approximations")
            state = passed.where("row is not null").select("row", "cells", "cluster")
        else:
            tried = materialize(spark, state.mapInArrow(_decide(cells, centroids), _PASS_SQL), "decided")
            ask = tried.where("cluster <> old").select("row", "cluster", "old", "cand")  # undecided (-1) or moved
            passed = materialize(spark, ask.join(full.select("row", "q"), "row").mapInArrow(_resolve(centroids), _PASS_SQL), "fetched")
            if number < rounds - 1:
                settled = passed.where("row is not null").select("row", F.col("cluster").alias("_cluster"))
                state = tried.join(settled, "row", "left").select("row", "cells", F.coalesce("_cluster", "cluster").alias("cluster"))
        centroids = update(passed)
    return full.mapInArrow(_finish(cells, centroids), out_sql), centroids.tolist()


def va_clusters(embeddings: DataFrame, **how) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = embeddings.sparkSession
    found, centroids = cluster_vectors(embeddings, **how)
    found = materialize(spark, found, "clusters")
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = sum(sums.values())
    named = [(c, sums[c], whole, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids) if c in sums]
    named = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
