"""Vector columns: which rows take part, and their numbers as bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tamis.llm.frames import materialize


def usable(vec: Column, nonzero: bool) -> Column:
    """Not null, no null or non-finite component, and (if asked) not the zero vector."""
    ok = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return ok & F.exists(vec, lambda x: x != 0) if nonzero else ok


def vector_rows(df: DataFrame, id_col: str, vec_col: str, nonzero: bool) -> tuple[DataFrame, int, bool, int]:
    """(vec_id, vec array<double>) of the rows that take part, written once; their number; whether a vec_id occurs again; the longest length."""
    rows = df.select(df["`" + id_col + "`"].cast("long").alias("vec_id"), df["`" + vec_col + "`"].cast("array<double>").alias("vec"))
    rows = materialize(df.sparkSession, rows.where(F.col("vec_id").isNotNull() & F.coalesce(usable(F.col("vec"), nonzero), F.lit(False))), "vectors")
    n, ids, dim = rows.agg(F.count(F.lit(1)), F.countDistinct("vec_id"), F.max(F.size("vec"))).first()
    return rows, int(n), n != ids, int(dim or 0)


def matrix(column, dim: int) -> np.ndarray:
    """(rows, dim) of an Arrow list column without nulls; shorter vectors are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(column) else np.zeros(0, np.int64)
    if len(n) and (n == dim).all():
        return flat.reshape(len(n), dim)
    out = np.zeros((len(n), dim))
    out[np.arange(dim)[None, :] < n[:, None]] = flat
    return out


def blobs(m: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(m, dtype="<f8")], pa.binary())


def unblob(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, dim)


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query, ties to the smaller vec_id."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
