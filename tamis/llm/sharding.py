"""Two-pass external shuffle into shards (operator 9), DataFrame and SQL functions only.

Pass 1 scatters the records uniformly into buckets that fit in memory: the bucket is a
seeded hash of the record's number, so copies, a hot key or a hot source spread like any
other rows. Pass 2 Fisher-Yates shuffles each bucket (Spark's ``shuffle`` on the bucket's
array of records) and writes it to the shared folder. The written order is the global
order: its positions are cut into ``n_shards`` contiguous ranges, so shard sizes differ by
one row at most (law ``rows``) and slots are gapless.

Each record crosses the network once. Buckets are gathered by sorting: a task holds one bucket
at a time, however few partitions the session's shuffles have (a hash aggregate would keep
up to 128 buckets on the heap), and what it has not come to yet can spill. Bucket offsets are a prefix sum over the buckets'
row counts; there are at most ``max_buckets`` of them, which bounds what is broadcast.

The records' numbers come from the input's partitions, so the input should be a table (a
scan) or a checkpoint, whose partitions read the same rows again when a task is repeated.

Edge cases. Nulls in any column stay as they are. Repeated rows are separate records with
slots of their own. A record larger than a bucket gets a bucket's memory for itself and
its neighbours. An empty table gives an empty result. Columns of the input named like the
columns added here (``shard``, ``slot``, or the given names) are replaced.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tamis.llm.frames import fresh, materialize


@contextmanager
def _one_group_at_a_time(spark: SparkSession):
    """Plans made inside gather lists by sorting, one group in memory, not in a hash table of groups."""
    name = "spark.sql.execution.useObjectHashAggregateExec"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def external_shuffle(df: DataFrame, *, size=None, bucket_bytes: int = 24 << 20, max_buckets: int = 4_000_000,
                     seed: int = 29) -> tuple[DataFrame, str, str]:
    """(the written records, bucket column, position column): a uniform random order in two passes.

    ``size``: a column expression of a record's bytes (default: the sum of its string and
    binary columns and 16 more).
    """
    spark = df.sparkSession
    if size is None:
        size = F.lit(16)
        for name, kind in df.dtypes:
            if kind in ("string", "binary"):
                size = size + F.coalesce(F.octet_length(df["`" + name.replace("`", "``") + "`"]), F.lit(0))
    n_bytes = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    buckets = int(min(max_buckets, max(1, -(-n_bytes // bucket_bytes))))
    number, bucket, pos, rows, row = (fresh(x) for x in ("number", "bucket", "pos", "rows", "row"))
    record = F.struct(*[df["`" + c.replace("`", "``") + "`"] for c in df.columns])
    scattered = (df.select(record.alias(row), F.monotonically_increasing_id().alias(number))
                 .withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), F.col(number)), F.lit(buckets)).cast("int")))
    gathered = scattered.groupBy(bucket).agg(F.collect_list(F.struct(number, row)).alias(rows))
    ordered = F.array_sort(F.col(rows), lambda a, b: F.when(a[number] < b[number], -1).otherwise(1))
    shuffled = (gathered.select(bucket, F.posexplode(F.shuffle(ordered, seed)).alias(pos, rows))
                .select(bucket, pos, f"{rows}.{row}.*"))
    with _one_group_at_a_time(spark):
        return materialize(spark, shuffled, "shuffled"), bucket, pos


def shard_records(df: DataFrame, *, n_shards: int = 16, shard_col: str = "shard", slot_col: str = "slot",
                  seed: int = 29, **how) -> DataFrame:
    """``df``'s records with a shard (0 to n_shards - 1) and a gapless slot in it, in random order."""
    df = df.drop(shard_col, slot_col)
    written, bucket, pos = external_shuffle(df, seed=seed, **how)
    n, before, span, p = (fresh(x) for x in ("n", "before", "span", "at"))
    counts = written.groupBy(bucket).agg(F.count(F.lit(1)).alias(n)).withColumn(span, F.expr(f"{bucket} div 4096"))
    spans = counts.groupBy(span).agg(F.sum(n).alias(n))
    base = spans.select(span, (F.sum(n).over(Window.orderBy(span)) - F.col(n)).alias(before), F.sum(n).over(Window.partitionBy()).alias(p))
    offsets = (counts.join(F.broadcast(base), span)  # at most max_buckets / 4096 rows
               .select(bucket, (F.col(before) + F.sum(n).over(Window.partitionBy(span).orderBy(bucket)) - F.col(n)).alias(before),
                       F.col(p).alias(n)))
    placed = (written.join(F.broadcast(offsets), bucket)  # one row per bucket, at most max_buckets
              .withColumn(p, F.col(before) + F.col(pos)))
    total, at = F.col(n), F.col(p)
    shard = F.expr(f"cast(({n_shards} * ({p} + 1) - 1) div {n} as int)")
    return (placed.withColumn(shard_col, shard)
            .withColumn(slot_col, at - F.expr(f"({shard_col} * {n}) div {n_shards}"))
            .drop(bucket, pos, n, before, span, p))


def write_shards(df: DataFrame, path: str, **how) -> None:
    """The shuffled records as Parquet under path/shard=<k>/, each shard's rows in slot order."""
    out = shard_records(df, **how)
    shard, slot = how.get("shard_col", "shard"), how.get("slot_col", "slot")
    out.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def sharding(docs: DataFrame, n_shards: int = 16, **how) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    sized = shard_records(docs, n_shards=n_shards, **how)
    return sized.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
