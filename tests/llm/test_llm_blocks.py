"""Blocks bounded by rows and bytes, and shards gathered one bucket at a time."""

import random

from pyspark.sql import functions as F

from tamis.llm import frames, sharding, substring
from tests.llm.test_llm_dedup import brute_repeats, repeats


def test_blocks_keep_both_bounds_and_few_buckets(spark, monkeypatch):
    names = [frames.fresh("test_blocks"), frames.fresh("test_blocks")]
    name = names[0]
    monkeypatch.setattr(frames, "_MAX_BUCKETS", 3)
    monkeypatch.setattr(frames, "fresh", lambda stem: names.pop(0))
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", "ä" * 40, "x" * rng.randrange(300), "y" * 5000]), "z") for i in range(400)]
    blocks = frames.write_blocks(spark.createDataFrame(rows, "n long, text string, more string").repartition(8), "text", 16, 900)
    assert sorted((r.n, r.text, r.more) for r in blocks.collect()) == rows
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    for r in blocks.groupBy("block").agg(F.count("*").alias("n"), F.sum(size).alias("b")).collect():
        assert r.n <= 16 and (r.b <= 900 or r.n == 1)
    detail = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    assert detail["Num Buckets"] == "3"
    assert frames.write_blocks(blocks.drop("block").limit(0), "text", 16, 900).count() == 0


def test_a_prefix_repeated_inside_few_texts_is_hot(spark):
    text = "same " * 3000
    rows = [(0, text), (1, text + "end"), (2, "other words " * 50), (3, "x " * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert repeats(df, hot=100, block_bytes=1000, group_bytes=1000) == brute_repeats(rows, 13)
    a = substring.Anchors(df.toArrow().column("text"), 13, 5)
    key, docs, runs = a.counts(df.toArrow().column("doc_id").to_numpy())
    both = (3000 - 12) + (3001 - 12)  # the last window's anchor may be the prefix with the last word
    assert docs.max() == 2 and runs.max() in (both - 1, both)


def test_a_task_gathers_one_bucket_at_a_time(spark):
    before = spark.conf.get("spark.sql.execution.useObjectHashAggregateExec")
    lists = spark.range(100).groupBy(F.col("id") % 7).agg(F.collect_list("id"))
    with sharding._one_group_at_a_time(spark):
        plan = lists.select("*")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "ObjectHashAggregate" not in plan
    assert spark.conf.get("spark.sql.execution.useObjectHashAggregateExec") == before
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("t"), 50).alias("text")).repartition(6)
    out = sharding.sharding(df, bucket_bytes=400).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top"), F.countDistinct("slot").alias("d")).collect()
    assert len(out) == 16 and all(r.n == r.d == r.top + 1 and r.n in (187, 188) for r in out)
