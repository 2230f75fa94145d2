import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tamis.operators.history import BankHistory, moderate_as_of
from tamis.operators.keyword import KeywordMatcher
from tamis.operators.matchers import BankTooLarge
from tamis.operators.policy import moderate
from tamis.session import scratch_path
from tamis.streaming.moderate import moderate_stream_history

T0 = dt.datetime(2024, 5, 1)
HOUR = dt.timedelta(hours=1)


def change(h, word, removed=False, severity="high", type_="t", action="block"):
    return (T0 + h * HOUR, word, type_, severity, action, removed)


LOG = [change(1, "alpha"), change(3, "alpha", severity="low"), change(5, "alpha", removed=True), change(7, "alpha"),
       change(3, "beta gamma"), change(3, "gamma"), change(7, "gamma", removed=True), (None, "x", "t", "high", "block", False),
       (T0, None, "t", "high", "block", False)]


def texts(spark, rows):
    return spark.createDataFrame([(i, t, None if h is None else T0 + h * HOUR) for i, (h, t) in enumerate(rows)], "id long, text string, ts timestamp_ntz")


def test_versions_and_ranges():
    h = BankHistory(LOG)
    assert len(h.times) == 4
    assert [[r["word"] for r in h.bank(v)] for v in range(6)] == [[], ["alpha"], ["alpha", "beta gamma", "gamma"], ["beta gamma", "gamma"], ["alpha", "beta gamma"], ["alpha", "beta gamma"]]
    assert h.bank(2)[0]["severity"] == "low" and h.bank(1)[0]["severity"] == "high"


def test_changes_at_one_time_have_one_outcome():
    rows = [change(1, "a", removed=True), change(1, "a", severity="low"), change(1, "a", severity="high"), change(2, "a", removed=True)]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        assert [(r["severity"], r["lo"], r["hi"]) for r in BankHistory(order).ranges] == [("low", 1, 2)]
    with pytest.raises(BankTooLarge):
        BankHistory(rows, max_changes=3)


def test_each_text_is_judged_by_the_bank_of_its_time(spark):
    rows = [(h, "alpha beta gamma alpha") for h in (0, 1, 2, 3, 4.5, 5, 6, 7, 100)] + [(None, "alpha"), (3, None), (3, "")]
    got = {r.id: r for r in moderate_as_of(texts(spark, rows), BankHistory(LOG), keep=("text",)).collect()}
    history = BankHistory(LOG)
    assert [got[i].bank_version for i in range(12)] == [0, 1, 1, 2, 2, 3, 3, 4, 4, None, 2, 2]
    for i, (h, t) in enumerate(rows):
        bank = history.bank(got[i].bank_version or 0)
        want = moderate(texts(spark, [(h, t)]), [KeywordMatcher(bank)]).first()
        assert (got[i].flagged, got[i].action, got[i].n_hits) == (want.flagged, want.action, want.n_hits)
        assert sorted((x.word, x.severity, x.idx) for x in got[i].hits) == sorted((x.word, x.severity, x.idx) for x in want.hits)


def test_random_logs_against_a_replay(spark):
    rng = random.Random(3)
    words = ["ab", "abc", "b", "ca", "éa", "aba b"]
    log = [(T0 + dt.timedelta(microseconds=rng.randrange(40)), rng.choice(words), rng.choice("xy"), rng.choice(["low", "high"]), "block", rng.random() < .4) for _ in range(60)]
    rows = [(dt.timedelta(microseconds=rng.randrange(-2, 42)) / HOUR, "".join(rng.choice("abcé ") for _ in range(30))) for _ in range(60)]
    h = BankHistory(spark.createDataFrame(log, "at timestamp_ntz, word string, type string, severity string, action string, removed boolean"))
    assert h.ranges == BankHistory(log).ranges

    def at(word, when):
        past = [r for r in log if r[1] == word and r[0] <= when]
        latest = [r for r in past if r[0] == max(x[0] for x in past)]
        alive = [r for r in latest if not r[5]]
        return max(alive, key=lambda r: r[2:5]) if alive else None

    df = texts(spark, rows)
    for r in moderate_as_of(df, h, keep=("text", "ts")).collect():
        want = sorted((w, at(w, r.ts)[3], i) for w in words if at(w, r.ts) for i in range(len(r.text)) if r.text.startswith(w, i))
        assert sorted((x.word, x.severity, x.idx) for x in r.hits) == want


def test_a_stream_gives_the_same_after_the_log_grew(spark, tmp_path):
    rows = [(h, "alpha gamma") for h in (0, 1, 3, 5, 7)]
    src = str(tmp_path / "in")
    texts(spark, rows).repartition(5).write.parquet(src)
    stream = spark.readStream.schema("id long, text string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(src)
    out = []
    for log in (LOG[:-2], [*LOG, change(50, "zeta"), change(60, "alpha", removed=True)]):
        sink = scratch_path(spark, "history")
        moderate_stream_history(stream, lambda: log, sink, scratch_path(spark, "history-ck")).awaitTermination()  # noqa: B023
        got = spark.read.parquet(sink)
        assert got.select("batch_id").distinct().count() > 1
        out.append(sorted(tuple(r) for r in got.select("id", "bank_version", "n_hits").collect()))
    assert out[0] == out[1] == [(0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 3, 1), (4, 4, 1)]


def test_empty_history_and_one_projection(spark):
    df = texts(spark, [(1, "alpha"), (None, None)])
    assert [r.flagged for r in moderate_as_of(df, BankHistory([])).collect()] == [False, False]
    plan = moderate_as_of(df, BankHistory(LOG), mode="parallel")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert moderate_as_of(df.limit(0), BankHistory(LOG)).withColumn("x", F.lit(1)).count() == 0
