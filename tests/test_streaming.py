import os

from pyspark.sql import functions as F

from tamis.operators.keyword import KeywordMatcher
from tamis.operators.policy import moderate
from tamis.plans.fixtures import DOC_BANK
from tamis.streaming.moderate import moderate_stream, moderate_stream_reload, run_available_now, bank_version
from tamis.operators.report import flag_rate
from tamis.session import scratch_path

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet").parquet(SF)
    km = [KeywordMatcher(DOC_BANK)]
    out = moderate_stream(stream.select("doc_id", "text"), km, id_col="doc_id").select("id", "flagged", "n_hits")
    got = sorted(tuple(r) for r in spark.read.parquet(run_available_now(spark, out, "t-stream")).collect())
    batch = moderate(spark.read.parquet(f"{SF}/documents.parquet"), km, id_col="doc_id")
    assert got == sorted(tuple(r) for r in batch.select("id", "flagged", "n_hits").collect())


def test_hot_reload_uses_new_bank(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    spark.createDataFrame([(1, "alpha beta")], "id long, text string").write.parquet(str(src / "b0"))
    banks = [[("alpha", "t", "high", "block")]]
    sink, ck = scratch_path(spark, "reload"), scratch_path(spark, "reload-ck")
    stream = spark.readStream.schema("id long, text string").parquet(str(src / "*"))

    def run():
        q = moderate_stream_reload(stream, lambda: banks[-1], lambda rows: [KeywordMatcher(rows)], sink, ck)
        q.awaitTermination()

    run()
    banks.append([("beta", "t", "high", "block"), ("gamma", "t", "high", "block")])
    spark.createDataFrame([(2, "gamma")], "id long, text string").write.parquet(str(src / "b1"))
    run()
    rows = sorted((r.id, r.flagged, r.bank_version) for r in spark.read.parquet(sink).collect())
    assert rows[0][:2] == (1, True) and rows[1][:2] == (2, True)
    assert rows[0][2] == bank_version([dict(word="alpha", type="t", severity="high", action="block")])
    assert rows[0][2] != rows[1][2]


def test_flag_rate_watermark_drops_late_rows(spark, tmp_path):
    import datetime as dt
    d = tmp_path / "ev"
    base = dt.datetime(2024, 1, 1)
    b0 = [(base + dt.timedelta(minutes=m), m % 2 == 0) for m in (0, 10, 70, 200)]
    # one file per micro-batch, so the watermark advances only after the whole first batch
    spark.createDataFrame(b0, "ts timestamp, bad boolean").coalesce(1).write.parquet(str(d / "b0"))
    stream = spark.readStream.schema("ts timestamp, bad boolean").option("maxFilesPerTrigger", 1).parquet(str(d / "*"))
    agg = flag_rate(stream, "ts", F.col("bad"), window="1 hour", watermark="30 minutes")
    q = agg.writeStream.outputMode("update").format("memory").queryName("fr").start()
    q.processAllAvailable()
    late = [(base + dt.timedelta(minutes=5), True)]  # far behind the watermark now
    spark.createDataFrame(late, "ts timestamp, bad boolean").coalesce(1).write.parquet(str(d / "b1"))
    q.processAllAvailable()
    q.stop()
    first = spark.sql("SELECT n_events FROM fr WHERE window_start = timestamp'2024-01-01 00:00:00'").collect()
    assert max(r.n_events for r in first) == 2
