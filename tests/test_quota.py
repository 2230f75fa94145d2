import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tamis.streaming.quota import TokenBucket, quota_audit, refill_micros, with_segments


def events(spark, rows):
    base = dt.datetime(2024, 1, 1)
    data = [(i, base + dt.timedelta(seconds=s), k, p) for i, (k, s, p) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id long, ts timestamp, user_id long, path string")


def admitted(spark, rows, rate, cap, exempt=False):
    ev = events(spark, rows)
    ex = (F.col("path") == "/health") if exempt else None
    r = quota_audit(ev, "user_id", "ts", rate, cap, tiebreak="event_id", exempt=ex)
    return [x.admitted for x in r.orderBy("tiebreak").collect()]


def test_within_limit_admitted(spark):
    assert admitted(spark, [(1, 0, "/"), (1, 0, "/"), (1, 0, "/")], rate=100, cap=200) == [True] * 3


def test_exhausted_bucket_refills(spark):
    # capacity 2, one token per 10 s: two at t=0, a third refused, one more at t=10
    rows = [(1, 0, "/"), (1, 0, "/"), (1, 0, "/"), (1, 9, "/"), (1, 10, "/"), (2, 0, "/")]
    assert admitted(spark, rows, rate=0.1, cap=2) == [True, True, False, False, True, True]


def test_zero_rate_zero_capacity_refuses_all_but_exempt(spark):
    rows = [(1, 0, "/"), (1, 5, "/health"), (1, 9, "/x")]
    assert admitted(spark, rows, rate=0, cap=0) == [False, False, False]
    assert admitted(spark, rows, rate=0, cap=0, exempt=True) == [False, True, False]


def test_zero_rate_is_a_one_time_quota():
    b = TokenBucket(0, 2)
    st = b.start()
    out = []
    for t in (0, 10**12, 10**15):
        ok, _, st = b.step(st, t)
        out.append(ok)
    assert out == [True, True, False]


def test_refused_event_changes_nothing():
    b = TokenBucket(1.0, 1)
    ok1, _, st = b.step(None, 0)
    ok2, _, st2 = b.step(st, 500_000_000)  # half a token: refused, state kept
    assert ok1 and not ok2 and st2 == st
    ok3, _, _ = b.step(st2, 1_000_000_000)
    assert ok3


def test_matches_python_pass_on_events(spark):
    from tamis.plans.fixtures import QUOTA_RATE, QUOTA_CAPACITY
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = {r.tiebreak: r.admitted for r in
           quota_audit(ev, "user_id", "ts", QUOTA_RATE, QUOTA_CAPACITY, tiebreak="event_id").collect()}
    pdf = ev.select("event_id", "user_id", "ts").toPandas().sort_values(["user_id", "ts", "event_id"])
    b, exp, cur, st = TokenBucket(QUOTA_RATE, QUOTA_CAPACITY), {}, None, None
    for e, u, t in pdf.itertuples(index=False):
        if u != cur:
            cur, st = u, None
        ok, _, st = b.step(st, int(t.value))
        exp[e] = ok
    assert got == exp


def drained(spark, rows, schema, parts, tmp_path, delay, rate, cap, exempt=None):
    """Admissions of a stream that takes one part per micro-batch; two heartbeats end it."""
    from tamis.streaming.quota import quota_audit_stream
    from tamis.streaming.moderate import run_available_now
    path = str(tmp_path / "parts")
    last = max(r[1] for r in rows) + dt.timedelta(days=400)
    for part in [*parts, [(rows[0][0], last, -1)], [(rows[0][0], last, -1)]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = quota_audit_stream(stream, "k", "ts", rate, cap, tiebreak="e", exempt=exempt, delay=delay, heartbeat=F.col("e") < 0)
    got = spark.read.parquet(run_available_now(spark, out, "q-stream")).collect()
    assert len(got) == len({r.tiebreak for r in got})
    return {r.tiebreak: (r.key, r.ts, r.admitted) for r in got}


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_stream_over_shuffled_parts_equals_batch(spark, tmp_path, kind):
    rng, base = random.Random(6), dt.datetime(2024, 1, 1)
    rows = [(rng.choice([1, 2, None]), base + dt.timedelta(microseconds=rng.randrange(60 * 86_400 * 10 ** 6)), e) for e in range(240)]
    rows += [(1, base + dt.timedelta(days=7), e) for e in range(240, 250)]
    rng.shuffle(rows)
    schema = f"k long, ts {kind}, e long"
    got = drained(spark, rows, schema, [rows[i::4] for i in range(4)], tmp_path, "61 days", 1 / 86400, 3)
    exp = {r.tiebreak: (r.key, r.ts, r.admitted) for r in quota_audit(spark.createDataFrame(rows, schema), "k", "ts", 1 / 86400, 3, tiebreak="e").collect()}
    assert got == exp and 0 < sum(a for _, _, a in got.values()) < len(rows)


def test_stream_releases_behind_the_watermark_only(spark, tmp_path):
    from tamis.streaming.quota import quota_audit_stream
    from tamis.streaming.moderate import run_available_now
    base, path = dt.datetime(2024, 1, 1), str(tmp_path / "parts")
    at = lambda d, e: (1, base + dt.timedelta(days=d), e)
    for part in ([at(1, 0), at(3, 1)], [at(2, 2), at(9, 3)], [at(5, 4), at(4, 5), at(20, 6)], [at(21, 7)]):
        spark.createDataFrame(part, "k long, ts timestamp, e long").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("k long, ts timestamp, e long").option("maxFilesPerTrigger", 1).parquet(path)
    out = quota_audit_stream(stream, "k", "ts", 0.0, 3, tiebreak="e", delay="3 days")
    got = {r.tiebreak: r.admitted for r in spark.read.parquet(run_available_now(spark, out, "q-late")).collect()}
    assert got == {0: True, 2: True, 1: True, 3: False, 4: False, 5: False}  # 20 and 21 still wait


def test_null_keys_are_one_key_and_exempt_rows_take_none(spark):
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    rows = [(None, base + dt.timedelta(seconds=i), i) for i in range(5)]
    df = spark.createDataFrame(rows, "k long, ts timestamp, e long")
    got = {r.tiebreak: r.admitted for r in quota_audit(df, "k", "ts", 0.0, 1, tiebreak="e").collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: False}
    free = {r.tiebreak: r.admitted for r in quota_audit(df, "k", "ts", 0.0, 1, tiebreak="e", exempt=F.col("e") < 3).collect()}
    assert free == {0: True, 1: True, 2: True, 3: True, 4: False}


def test_exempt_rows_in_the_stream(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i % 2, base + dt.timedelta(seconds=i), i) for i in range(12)]
    got = drained(spark, rows, "k long, ts timestamp, e long", [rows[:7], rows[7:]], tmp_path, "1 hour", 0.0, 1, exempt=F.col("e") < 4)
    assert {e for e, r in got.items() if r[2]} == {0, 1, 2, 3, 4, 5}


def one_by_one(rows, rate, cap):
    """The row-by-row walk of (key, microsecond, event), keys apart."""
    b, out, state = TokenBucket(rate, cap), {}, {}
    for k, us, e in sorted(rows, key=lambda r: (r[1], r[2])):
        ok, tok, state[k] = b.step(state.get(k), us * 1000)
        out[e] = (ok, tok)
    return out


@pytest.mark.parametrize("rate,cap", [(1 / 3, 2), (0.1, 1), (7.0, 5), (1e-3, 3), (0.0, 2), (math.inf, 1), (1.0, 0)])
def test_segments_change_nothing_and_spread_a_hot_key(spark, rate, cap):
    rng = random.Random(8)
    us, rows = -5_000_000, []
    for e in range(3000):
        us += rng.choice([0, 1, 400_000, 1_500_000, 6_000_000, 10_000_000, 40_000_000, 3_000_000_000]) if rng.random() < .7 else rng.randrange(9_000_000)
        rows.append((7 if rng.random() < .9 else rng.choice([1, None]), us, e))
    base = dt.datetime(1970, 1, 1)
    df = spark.createDataFrame([(k, base + dt.timedelta(microseconds=u), e) for k, u, e in rows], "k long, ts timestamp_ntz, e long").repartition(5)
    got = {r.tiebreak: (r.admitted, r.tokens) for r in quota_audit(df, "k", "ts", rate, cap, tiebreak="e").collect()}
    assert got == one_by_one(rows, rate, cap)
    refill = refill_micros(rate, cap)
    segments = with_segments(df.toDF("key", "ts", "tiebreak"), refill)
    sizes = [r["count"] for r in segments.where("key = 7").groupBy("segment").count().collect()]
    assert sum(sizes) == sum(k == 7 for k, _, _ in rows)
    if refill and refill < 10 ** 8:
        assert len(sizes) > 100 and max(sizes) < 0.2 * len(rows)


def test_refill_time_is_the_least_that_fills_the_bucket():
    for rate, cap in [(1 / 432000, 2), (0.1, 3), (1 / 3, 1), (1e6, 4), (3e-7, 9)]:
        us, b = refill_micros(rate, cap), TokenBucket(rate, cap)
        assert b.step((0.0, 0), us * 1000)[1] == cap - 1.0
        assert us == 1 or b.step((0.0, 0), (us - 1) * 1000)[1] < cap - 1.0 or not b.step((0.0, 0), (us - 1) * 1000)[0]
    assert refill_micros(0.0, 2) is None and refill_micros(math.inf, 2) is None and refill_micros(1.0, 0) is None and refill_micros(1e-300, 2) is None
