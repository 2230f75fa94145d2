import datetime as dt

from pyspark.sql import functions as F

import pandas as pd

from tamis.operators.report import histogram, running_level, top_words, hit_counts, last_value


def test_histogram(spark):
    df = spark.createDataFrame([(0.5,), (3.0,), (5.0,), (7.5,), (100.0,)], "v double")
    r = histogram(df, "v", [1, 5, 10]).first().asDict()
    assert (r["le_1"], r["le_5"], r["le_10"], r["le_inf"], r["count"], r["sum"]) == (1, 3, 4, 5, 5, 116.0)


def test_running_level_crosses_buckets(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=37 * i), i % 3, float(i % 5) - 1.5) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, k long, v double")
    got = {r.event_id: float(r.level) for r in running_level(df, "k", "ts", "v", "event_id").collect()}
    pdf = pd.DataFrame(rows, columns=["event_id", "ts", "k", "v"]).sort_values(["k", "ts", "event_id"])
    pdf["lvl"] = pdf.groupby("k")["v"].cumsum()
    assert got == dict(zip(pdf.event_id, pdf.lvl))


def test_last_value_and_top_words(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, base, 1, 1.0), (2, base, 1, 2.0), (3, base - dt.timedelta(1), 1, 9.0)],
                               "event_id long, ts timestamp, k long, v double")
    assert last_value(df, "k", "ts", "v", "event_id").first().last_value == 2.0
    hits = spark.createDataFrame([(1, "a", "t"), (2, "a", "t"), (1, "b", "t"), (1, "c", "u")],
                                 "id long, word string, type string")
    assert [(r.type, r.word, r.n) for r in top_words(hits, 1).orderBy("type").collect()] == [("t", "a", 2), ("u", "c", 1)]
    roll = {(r.type, r.word): r.n_hits for r in hit_counts(hits, ("type", "word"), subtotals="rollup").collect()}
    assert roll[(None, None)] == 4 and roll[("t", None)] == 3


def test_running_level_hot_key_over_many_partitions(spark):
    base = dt.datetime(2024, 1, 1)
    # one key holds almost every row, all within one hour
    rows = [(i, base + dt.timedelta(seconds=i), 0 if i % 50 else 1 + i % 3, 0.25 * (i % 7) - 0.5)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, k long, v double")
    got = {r.event_id: float(r.level) for r in running_level(df, "k", "ts", "v", "event_id", bucket="minute").collect()}
    pdf = pd.DataFrame(rows, columns=["event_id", "ts", "k", "v"]).sort_values(["k", "ts", "event_id"])
    pdf["lvl"] = pdf.groupby("k")["v"].cumsum().round(2)
    assert got == dict(zip(pdf.event_id, pdf.lvl))


def test_materialized_hits_feed_verdicts_and_reports(spark):
    from tamis.session import materialize
    from tamis.operators.keyword import match_keywords
    from tamis.operators.policy import moderate_hits
    df = spark.createDataFrame([(1, "bad bad"), (2, "ok"), (3, "bad")], "id long, text string")
    hits = materialize(spark, match_keywords(df, [("bad", "t", "high", "block")]), "hits")
    assert "FileScan" in hits._jdf.queryExecution().executedPlan().toString()
    v = {r.id: r.n_hits for r in moderate_hits(df, hits).collect()}
    assert v == {1: 2, 2: 0, 3: 1}
    assert hit_counts(hits, ("word",)).first().n_texts == 2


def test_running_level_keep_null_keys_and_thousandths(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=7 * (i % 40)) if i % 13 else None, None if i % 3 == 0 else i % 2, 0.004 * (i % 5), "n%d" % i) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, k long, v double, note string").repartition(8)
    got = {r.event_id: (r.note, float(r.level)) for r in running_level(df, "k", "ts", "v", "event_id", keep=("note",)).collect()}
    run, want = {}, {}
    for i, ts, k, v, note in sorted(rows, key=lambda r: (r[1] or dt.datetime.min, r[0])):
        run[k] = run.get(k, 0) + round(v * 1000)
        want[i] = (note, run[k] / 1000)
    assert got == want
    ints = running_level(df.withColumn("n", F.lit(2)), "k", "event_id", "n", "event_id", width=50).orderBy(F.col("level").desc()).first()
    assert ints.level == 2 * max(sum(r[2] == k for r in rows) for k in (None, 0, 1))
    assert histogram(spark.createDataFrame([(0.004,)] * 3, "v double"), "v", [1]).first()["sum"] == 0.012
