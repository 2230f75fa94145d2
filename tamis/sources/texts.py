"""Text-table source (S7): any DataFrame becomes moderation contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tamis import fixed


def as_contexts(df: DataFrame, id: str = "id", text: str = "text", point: str | None = None,
                app_id: str | None = None, keep: tuple = ()) -> DataFrame:
    """(id, text, point, app_id[, keep...]); point defaults to 'input', app_id to NULL.

    Only the named columns are selected, so a parquet scan reads just those.
    """
    cols = [F.col(id).alias("id"), F.col(text).cast("string").alias("text"),
            (F.coalesce(F.col(point), F.lit(fixed.POINT_INPUT)) if point else F.lit(fixed.POINT_INPUT)).alias("point"),
            (F.col(app_id).cast("string") if app_id else F.lit(None).cast("string")).alias("app_id")]
    return df.select(*cols, *[F.col(k) for k in keep])


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a batch input over the cores when it has fewer splits than cores.

    Text matching is CPU-bound; a small file with few row groups would leave cores
    idle. On a cluster input splits far outnumber cores and this is a no-op, so the
    text is never shuffled there.
    """
    if df.isStreaming:
        return df
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()  # a plain scan: planning only, no job
    except Exception:  # no RDD access (e.g. a remote session): leave the input as it is
        return df
    return df.repartition(target) if n < target else df
