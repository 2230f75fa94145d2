"""Reports (R1-R4): the service's counter / gauge / histogram types as rollups.

Every report is an aggregation with map-side partial aggregates, so a hot key
(one word, one user, one hour) is combined in every task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def hit_counts(hits: DataFrame, by=("type", "severity"), subtotals: str | bool | None = None,
               id_col: str = "id") -> DataFrame:
    """R1: hits and distinct texts per group; ``subtotals`` = "rollup" or "cube" adds
    subtotal rows with ``gid`` (grouping id, first column = highest bit)."""
    by = list(by)
    if subtotals is True:
        subtotals = "rollup"
    aggs = [F.count(F.lit(1)).alias("n_hits"), F.countDistinct(id_col).alias("n_texts")]
    if subtotals == "rollup":
        return hits.rollup(*by).agg(F.grouping_id().cast("int").alias("gid"), *aggs)
    if subtotals == "cube":
        return hits.cube(*by).agg(F.grouping_id().cast("int").alias("gid"), *aggs)
    return hits.groupBy(*by).agg(*aggs)


def top_words(hits: DataFrame, k: int, by: str = "type") -> DataFrame:
    """R4: the k most frequent words per ``by`` (ties by word). The window runs on
    the aggregated (by, word) table, one row per distinct word."""
    counts = hits.groupBy(by, "word").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by).orderBy(F.col("n").desc(), F.col("word"))
    return counts.withColumn("rk", F.row_number().over(w).cast("int")).filter(F.col("rk") <= k)


def last_value(df: DataFrame, key: str, ts: str, val: str, tiebreak: str | None = None) -> DataFrame:
    """R2 gauge Set: the last value per key by time (then ``tiebreak``)."""
    order = F.struct(F.col(ts), F.col(tiebreak)) if tiebreak else F.col(ts)
    return df.groupBy(key).agg(F.max_by(F.col(val), order).alias("last_value"),
                               F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_events"))


def running_level(df: DataFrame, key: str, ts: str, delta: str, tiebreak: str, keep: tuple = (),
                  bucket: str = "hour", width: float = 3600.0, scale: int | None = None) -> DataFrame:
    """R2 gauge Inc/Dec: the running sum of ``delta`` per key in (ts, tiebreak) order.

    Times are cut into buckets (``bucket`` for timestamps and dates, ``width`` for numbers).
    Totals per (key, bucket) are combined map-side and summed over earlier buckets; inside a
    bucket a window runs over (key, bucket). So a hot key is as many groups as it has
    buckets, and no sort holds more than one bucket of one key. NULL keys are one key, NULL
    times come first, a NULL delta adds nothing. Integers and decimals are summed as they
    are. Floating-point deltas are summed whole (see ``_exact_and_rest``) to a double; with
    ``scale`` they are rounded to decimals of that many places first, so the sum has no order.
    """
    t = df.schema[ts].dataType
    at = F.col(ts)
    cut = F.date_trunc(bucket, at) if t.typeName() in ("timestamp", "timestamp_ntz", "date") else F.floor(at / F.lit(width))
    kind = df.schema[delta].dataType.typeName()
    d = F.col(delta)
    if kind in ("float", "double"):
        parts = _exact_and_rest(d) if scale is None else [d.cast(f"decimal(38,{scale})")]
    else:
        parts = [d]
    sums = [f"_d{i}" for i in range(len(parts))]
    ev = df.select(F.col(key).alias("_k"), at.alias("_ts"), F.col(tiebreak).alias("_tb"), *[F.coalesce(p, F.lit(0).cast(d_type(p, df))).alias(x) for p, x in zip(parts, sums)],
                   cut.alias("_b"), *[F.col(c) for c in keep])
    total = ev.groupBy("_k", "_b").agg(*[F.sum(x).alias(x) for x in sums])
    earlier = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = total.select(F.col("_k").alias("_k2"), F.col("_b").alias("_b2"), *[F.sum(x).over(earlier).alias("_off" + x) for x in sums])
    j = ev.join(before, F.col("_k").eqNullSafe(F.col("_k2")) & F.col("_b").eqNullSafe(F.col("_b2")), "left")
    inside = Window.partitionBy("_k", "_b").orderBy("_ts", "_tb").rowsBetween(Window.unboundedPreceding, 0)
    levels = [F.sum(x).over(inside) + F.coalesce(F.col("_off" + x), F.lit(0)) for x in sums]
    level = levels[0] if len(levels) == 1 else levels[0].cast("double") + levels[1]
    return j.select(F.col("_k").alias(key), F.col("_ts").alias(ts), F.col("_tb").alias(tiebreak), *keep, level.alias("level"))


def _exact_and_rest(value: Column) -> list[Column]:
    """A double as a decimal of nine places, whose sum has no order, and the double that is left over.

    From 1e20 on (and for NaN) all of it is left over, so the decimals' sum has room.
    """
    x = value.cast("double")
    exact = F.when(F.abs(x) < F.lit(1e20), x.cast("decimal(38,9)")).otherwise(F.lit(0).cast("decimal(38,9)"))
    return [exact, F.when(F.abs(x) < F.lit(1e20), x - exact.cast("double")).otherwise(x)]


def d_type(column: Column, df: DataFrame):
    """The type a column expression has on ``df``."""
    return df.select(column.alias("x")).schema["x"].dataType


def histogram(df: DataFrame, val: str, buckets, by=(), scale: int | None = None) -> DataFrame:
    """R3: cumulative counts per upper bound (``le_<b>``), ``le_inf``, sum and count,
    in one aggregate. Values are summed whole (see ``_exact_and_rest``); with ``scale`` they
    are rounded to decimals of that many places first, so the sum has no order."""
    if scale is None:
        exact, rest = _exact_and_rest(F.col(val))
        total = F.sum(exact).cast("double") + F.sum(rest)
    else:
        total = F.sum(F.col(val).cast(f"decimal(38,{scale})")).cast("double")
    cols = []
    for b in sorted(buckets):
        name = ("le_" + (str(int(b)) if float(b).is_integer() else str(b))).replace(".", "_")
        cols.append(F.count_if(F.col(val) <= F.lit(float(b))).alias(name))
    cols += [F.count(F.col(val)).alias("le_inf"),
             total.alias("sum"),
             F.count(F.lit(1)).alias("count")]
    return df.groupBy(*by).agg(*cols)


def flag_rate(df: DataFrame, ts: str, flag: Column, window: str = "1 hour", slide: str | None = None,
              watermark: str | None = None, by=()) -> DataFrame:
    """ST3 (batch or stream): events and flagged events per time window.

    On a stream, ``watermark`` drops rows later than that behind the max event time.
    """
    src = df.withWatermark(ts, watermark) if watermark else df
    win = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (src.groupBy(win.alias("w"), *by)
            .agg(F.count(F.lit(1)).alias("n_events"), F.count_if(flag).alias("n_flagged"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by,
                    "n_events", "n_flagged", (F.col("n_flagged") / F.col("n_events")).alias("rate")))
