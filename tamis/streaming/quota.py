"""Quota audit (ST4): a token bucket per key, in time order.

Semantics of the service's limiter: the bucket starts full with ``capacity``
tokens and refills ``rate`` tokens per second up to ``capacity``; an event is
admitted when a whole token is there, and takes it; a refused event changes
nothing. ``rate = 0`` makes ``capacity`` a one-time quota; ``capacity = 0``
refuses everything.

Batch: the bucket is a sequential recurrence, but an idle time of capacity / rate or more fills it, whatever
happened before. A key's timeline is cut exactly there, and every (key, segment) is walked on
its own: rows are hash-partitioned and sorted by (key, segment, ts, tiebreak), and ``mapInPandas`` walks the sorted Arrow
batches carrying only the current segment's two numbers. Segments are found without a task that holds a key: time
is dealt into periods of that length; a window inside each (key, period), the last event of the period before, and a window over the
periods (one row each) give every event its segment's first event. So a key that holds most events is walked by as many
tasks as it has idle times; one that is never idle that long is one segment. Exempt events take no part.

Stream: ``transformWithState`` keeps, for groups of keys, each key's bucket (tokens, last time) and the events that the watermark
has not passed. An event-time timer releases them in order of time, so parts of the input may arrive in
any order within the watermark's delay, over any number of micro-batches.
"""

from __future__ import annotations

import datetime as dt
import math

import pandas as pd
from pyspark.sql import DataFrame, Row, Window, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tamis.functions.times import micros
from tamis.session import materialize

NS = 1_000_000_000
EPOCH = dt.datetime(1970, 1, 1)

# Code of this module runs on Python workers; ship it by value with the task so the
# workers need not have the package installed.
import sys as _sys
from pyspark import cloudpickle as _cp
_cp.register_pickle_by_value(_sys.modules[__name__])


class TokenBucket:
    """The limiter arithmetic on nanosecond timestamps (float64 tokens)."""

    def __init__(self, rate: float, capacity: int):
        self.rate = float(rate)
        self.cap = int(capacity)

    def start(self):
        return None  # (tokens, last_ns) once an event was admitted

    def step(self, state, t_ns: int):
        """Returns (admitted, tokens_after, new_state)."""
        if math.isinf(self.rate):
            return True, float(self.cap), state
        if state is None:
            tokens = float(self.cap)
        else:
            tok, last = state
            d = max(t_ns - last, 0)
            secs = float(d // NS) + float(d % NS) / 1e9
            tokens = min(float(self.cap), tok + secs * self.rate)
        after = tokens - 1.0
        if self.cap < 1:
            ok = False
        elif after >= 0:
            ok = True
        elif self.rate > 0:
            ok = int(1e9 * (-after / self.rate)) == 0
        else:
            ok = False
        if ok:
            return True, after, (after, t_ns)
        return False, tokens, state


def _out_schema(key_type, ts_type, tb_type) -> T.StructType:
    return T.StructType([T.StructField("key", key_type), T.StructField("ts", ts_type),
                         T.StructField("tiebreak", tb_type), T.StructField("admitted", T.BooleanType()),
                         T.StructField("tokens", T.DoubleType())])


def refill_micros(rate: float, capacity: int) -> int | None:
    """The least idle time in microseconds that surely fills the bucket, in the limiter's own arithmetic; None: no time does."""
    if not 0 < rate < math.inf or capacity < 1:
        return None
    fills = lambda us: (float(us // 1_000_000) + float(us % 1_000_000 * 1000) / 1e9) * rate >= capacity
    if capacity / rate > 1e11:  # seconds: some 3,000 years
        return None
    us = max(1, int(capacity / rate * 1e6) - 2)
    while not fills(us):
        us += 1
    return us


def with_segments(rows: DataFrame, refill: int | None) -> DataFrame:
    """``rows`` (key, ts, tiebreak, ...) with ``segment``: the microsecond of the first event since the key's last refill.

    No task holds a key: the windows are inside (key, period) and over one row per (key, period).
    """
    us = micros("ts", rows.schema["ts"].dataType)
    if refill is None:
        return rows.withColumn("segment", F.lit(0).cast("long"))
    k = rows.withColumn("_k", F.struct("key")).withColumn("_us", us)  # a struct: NULL is one key and joins itself
    k = k.withColumn("_period", F.expr(f"(_us - pmod(_us, {refill}L)) div {refill}L"))
    last = k.groupBy("_k", "_period").agg(F.max("_us").alias("_before")).withColumn("_period", F.col("_period") + 1)
    inside = Window.partitionBy("_k", "_period").orderBy("_us", "tiebreak")
    k = k.join(last, ["_k", "_period"], "left").withColumn("_before", F.coalesce(F.lag("_us").over(inside), "_before"))
    # two periods apart is a refill: the whole period between was idle
    begins = F.col("_before").isNull() | (F.col("_us") - F.col("_before") >= refill)
    k = k.withColumn("_first", F.max(F.when(begins, F.col("_us"))).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    k = materialize(rows.sparkSession, k, "quota")
    per = k.groupBy("_k", "_period").agg(F.max("_first").alias("_last"))
    before = Window.partitionBy("_k").orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    found = k.join(carried, ["_k", "_period"]).withColumn("segment", F.coalesce("_first", "_carried"))
    return found.select(*rows.columns, "segment")


def quota_audit(events: DataFrame, key: str, ts: str, rate: float, capacity: int, tiebreak: str | None = None,
                exempt: F.Column | None = None, partitions: int | None = None) -> DataFrame:
    """(key, ts, tiebreak, admitted, tokens) per event; ``exempt`` rows are admitted
    and take no token (the health-check path of the service)."""
    tb = tiebreak or ts
    base = events.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(tb).alias("tiebreak"),
                         F.coalesce(exempt if exempt is not None else F.lit(False), F.lit(False)).alias("_exempt"))
    fields = {f.name: f.dataType for f in base.schema.fields}
    schema = _out_schema(fields["key"], fields["ts"], fields["tiebreak"])
    counted = with_segments(base.where(~F.col("_exempt")).drop("_exempt"), refill_micros(rate, capacity))
    n = partitions or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = counted.repartition(n, "key", "segment").sortWithinPartitions("key", "segment", "ts", "tiebreak")
    bucket = TokenBucket(rate, capacity)

    def walk(batches):
        at, state = object(), None
        for pdf in batches:
            if pdf.empty:
                continue
            t_ns = pdf["ts"].astype("datetime64[us]").astype("int64").to_numpy() * 1000
            keys = [None if x else k for k, x in zip(pdf["key"].tolist(), pdf["key"].isna())]  # NULL is one key
            adm, toks = [], []
            for k, t in zip(zip(keys, pdf["segment"].tolist()), t_ns):
                if k != at:
                    at, state = k, bucket.start()
                ok, tok, state = bucket.step(state, int(t))
                adm.append(ok)
                toks.append(tok)
            yield pd.DataFrame({"key": pdf["key"], "ts": pdf["ts"], "tiebreak": pdf["tiebreak"],
                                "admitted": adm, "tokens": toks})

    out = sorted_.mapInPandas(walk, schema)
    if exempt is None:
        return out
    free = base.where("_exempt").select("key", "ts", "tiebreak", F.lit(True).alias("admitted"), F.lit(float("nan")).alias("tokens"))
    return out.unionByName(free)


class _Audit(StatefulProcessor):
    """Per group of keys: their buckets, and the events the watermark has not passed (released in order of time).

    The state of a group is one value of arrays, read and written once for all of its keys.
    """

    def __init__(self, bucket: TokenBucket, key_type: str, tiebreak_type: str):
        self.bucket = bucket
        self.state = (f"keys array<{key_type}>, us array<bigint>, tiebreaks array<{tiebreak_type}>, exempt array<boolean>, "
                      f"level_keys array<{key_type}>, tokens array<double>, last_ns array<bigint>")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", self.state)

    @staticmethod
    def _same(key):
        """A key as one that equals itself and can be looked up."""
        if isinstance(key, list):
            return tuple(key)
        return "NaN" if key != key else key

    def _release(self, new: list, upto_us: int):
        """Waiting rows (us, tiebreak, key, exempt) up to a time, walked; the others wait, with a timer at the first of them."""
        kept = self.group.get()
        rows, levels = new, {}
        if kept is not None:
            keys, us, tiebreaks, exempt, level_keys, tokens, last = kept
            rows = [*zip(us, tiebreaks, keys, exempt), *new]
            levels = {self._same(k): (k, (tok, ns)) for k, tok, ns in zip(level_keys, tokens, last)}
        rows.sort(key=lambda r: (r[0], r[1] is not None, r[1]))
        n = next((i for i, r in enumerate(rows) if r[0] > upto_us), len(rows))
        if rows[n:]:
            self.handle.registerTimer(rows[n][0] // 1000)
        done = []
        for us, tiebreak, key, free in rows[:n]:
            ok, tok = True, float("nan")
            if not free:
                k = self._same(key)
                before = levels[k][1] if k in levels else self.bucket.start()
                ok, tok, state = self.bucket.step(before, us * 1000)
                if state is not before:
                    levels[k] = (key, state)
            done.append(Row(key=key, ts=EPOCH + dt.timedelta(microseconds=us), tiebreak=tiebreak, admitted=ok, tokens=tok))
        wait, of = rows[n:], list(levels.values())
        self.group.update(([r[2] for r in wait], [r[0] for r in wait], [r[1] for r in wait], [r[3] for r in wait],
                           [k for k, _ in of], [s[0] for _, s in of], [s[1] for _, s in of]))
        return iter(done)

    def handleInputRows(self, key, rows, timerValues):
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # heartbeats are not filtered before: Spark would push that below the watermark
        new = [(r["us"], r["tiebreak"], r["key"], r["exempt"]) for r in rows if not r["beat"]]
        return self._release(new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return self._release([], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def quota_audit_stream(events_stream: DataFrame, key: str, ts: str, rate: float, capacity: int, tiebreak: str | None = None,
                       exempt: F.Column | None = None, delay: str = "0 seconds", heartbeat: F.Column | None = None,
                       groups: int = 1024) -> DataFrame:
    """The audit of a stream whose events may be out of order by up to ``delay`` (the watermark's).

    Events wait in the state until the watermark has passed them and are then judged in order of (ts, tiebreak);
    an event later than the delay is judged when it comes, as one that arrives now, or dropped by the watermark. Rows for which ``heartbeat`` holds only move the
    watermark (a source that ends sends one, so that its last events are released). One key's bucket is sequential.
    State is kept by ``groups`` groups of keys: a micro-batch costs a few calls to the state store per group, not per key;
    a group's state is in one task's memory, so a stream of very many keys takes more groups.
    The query needs the RocksDB state store (``run_available_now`` sets it).
    """
    tb = tiebreak or ts
    kind = events_stream.schema[ts].dataType
    base = events_stream.withColumn("_event_time", F.col(ts).cast("timestamp") if not isinstance(kind, T.TimestampNTZType) else F.timestamp_micros(micros(ts, kind)))
    base = base.withWatermark("_event_time", delay)
    us = F.unix_micros("_event_time")
    base = base.select(F.col(key).alias("key"), us.alias("us"), (us if tb == ts else F.col(tb)).alias("tiebreak"),
                       F.coalesce(exempt if exempt is not None else F.lit(False), F.lit(False)).alias("exempt"),
                       F.coalesce(heartbeat if heartbeat is not None else F.lit(False), F.lit(False)).alias("beat"), "_event_time")
    fields = {f.name: f.dataType for f in base.schema.fields}
    schema = _out_schema(fields["key"], T.TimestampNTZType(), fields["tiebreak"])
    audit = _Audit(TokenBucket(rate, capacity), fields["key"].simpleString(), fields["tiebreak"].simpleString())
    base = base.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))
    return base.groupBy("group").transformWithState(audit, schema, "Append", "EventTime")
