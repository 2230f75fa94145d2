"""Stream moderation (ST1) and word-bank hot reload (ST2).

Row verdicts are narrow (one projection per text), so a stream of texts is
moderated by the very plan used in batch: no state, append mode, and the result
equals the batch result on the same rows. Hot reload re-reads the bank in
``foreachBatch`` and stamps each output row with the bank version it used.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamis.operators.history import BankHistory, moderate_as_of
from tamis.operators.policy import moderate
from tamis.session import scratch_path


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def moderate_stream(texts_stream: DataFrame, matchers: list, **kw) -> DataFrame:
    """ST1: the verdict stream (append mode) of a text stream."""
    return moderate(texts_stream, matchers, **kw)


def bank_version(rows: list[dict]) -> str:
    h = hashlib.sha1()
    for r in sorted(rows, key=lambda r: r["word"]):
        h.update("\x1f".join(str(r.get(k) or "") for k in ("word", "type", "severity", "action")).encode())
        h.update(b"\x1e")
    return h.hexdigest()[:16]


def moderate_stream_reload(texts_stream: DataFrame, bank_loader, make_matchers, sink_path: str,
                           checkpoint: str, trigger: dict | None = None, **kw):
    """ST2: re-load the bank at every micro-batch; rows carry ``bank_version``.

    ``bank_loader()`` returns the bank (DataFrame or rows, config-size);
    ``make_matchers(bank_rows)`` builds the matchers. Output is appended as parquet.
    """
    from tamis.operators.matchers import bank_rows

    def per_batch(batch: DataFrame, batch_id: int):
        rows = bank_rows(bank_loader())
        out = moderate(batch, make_matchers(rows), **kw)
        (out.withColumn("bank_version", F.lit(bank_version(rows)))
            .withColumn("batch_id", F.lit(batch_id).cast("long"))
            .write.mode("append").parquet(sink_path))

    w = texts_stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def moderate_stream_history(texts_stream: DataFrame, load_changes, sink_path: str, checkpoint: str, ts_col: str = "ts",
                            others=(), trigger: dict | None = None, **kw):
    """ST2 by event time: the bank's change log is read again at every micro-batch, and each text is judged by the
    bank of its own time (``history``). Replayed texts get the same verdicts, whatever was added to the log
    with later times. Rows carry ``bank_version`` and ``batch_id``.
    """
    def per_batch(batch: DataFrame, batch_id: int):
        out = moderate_as_of(batch, BankHistory(load_changes()), ts_col=ts_col, others=others, **kw)
        out.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("append").parquet(sink_path)

    w = texts_stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def run_available_now(spark: SparkSession, stream_df: DataFrame, name: str, fmt: str = "parquet") -> str:
    """Drain a stream once (availableNow) into a fresh sink under the checkpoint
    folder; returns the sink path."""
    base = scratch_path(spark, name)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, ROCKSDB)  # read when the query starts; needed by operators with timers
    try:
        q = (stream_df.writeStream.format(fmt).outputMode("append")
             .option("checkpointLocation", base + "/_checkpoint").option("path", base + "/out")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    return base + "/out"
