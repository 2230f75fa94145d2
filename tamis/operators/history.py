"""Versions of a word bank, and verdicts by the bank of a text's own time (ST2).

A change log (at, word, type, severity, action, removed) is the bank's history: from ``at`` on a word has
these attributes, or is not in the bank (``removed``). Every distinct ``at`` is a version, numbered from 1; before
the first one the bank is empty (version 0). A word's changes give it validity ranges of versions.

A text is judged by the version of its time, found by a binary search over the versions' times; one pass
over the text finds the words of all versions, and those not valid in the text's version are left out
in the same projection. So the verdict depends on the text and the log only: a stream gives the same in any
batches, on replay, and as a batch job, and a text that comes late is judged by the bank of its time.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from tamis.functions.times import micros
from tamis.operators.grams import GramTable
from tamis.operators.matchers import BankTooLarge, Matcher, empty_hits, hit_struct
from tamis.operators.policy import moderate

CHANGES = ("at", "word", "type", "severity", "action", "removed")
_EVER = 2**31 - 1


class BankHistory:
    """The versions of a bank from its change log (a DataFrame, or rows with an ``at`` datetime).

    Of several changes of a word at one time a removal loses to an addition, and of additions the one with the
    greatest (type, severity, action) counts. Rows without a word or a time are skipped. More than
    ``max_changes`` rows are refused (``BankTooLarge``).
    """

    def __init__(self, changes, max_changes: int = 20_000):
        if isinstance(changes, DataFrame):
            cols = [micros("at", changes.schema["at"].dataType).alias("at"), *[F.col(c) for c in CHANGES[1:]]]
            rows = [tuple(r) for r in changes.select(*cols).limit(max_changes + 1).collect()]
        else:
            rows = [tuple(r[c] for c in CHANGES) if isinstance(r, dict) else tuple(r) for r in changes]
            rows = [(None if r[0] is None else (r[0] - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1), *r[1:]) for r in rows]
        if len(rows) > max_changes:
            raise BankTooLarge(f"the history has more than {max_changes} changes")
        rows = [r for r in rows if r[0] is not None and r[1]]
        rows.sort(key=lambda r: (r[1], r[0], not r[5], [(x is not None, x or "") for x in r[2:5]]))
        last = {(r[1], r[0]): r for r in rows}
        self.times = sorted({r[0] for r in rows})
        number = {t: i + 1 for i, t in enumerate(self.times)}
        changes = list(last.values())
        self.ranges: list[dict] = []
        for r, after in zip(changes, [*changes[1:], None]):
            until = number[after[0]] if after is not None and after[1] == r[1] else _EVER
            if not r[5]:
                self.ranges.append(dict(zip(CHANGES[1:5], r[1:5])) | {"lo": number[r[0]], "hi": until})

    def version(self, us: Column) -> Column:
        """The version at a time (microseconds since 1970); 0 before the first, null for no time."""
        times = F.from_json(F.lit(json.dumps(self.times)), "array<bigint>")
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(self.times).bit_length())))])
        found = F.aggregate(steps, F.lit(0), lambda v, step: F.when(F.coalesce(F.get(times, v + step - 1) <= us, F.lit(False)), v + step).otherwise(v))
        return F.when(us.isNotNull(), found)

    def bank(self, version: int) -> list[dict]:
        """The rows of the bank in a version."""
        return [{c: r[c] for c in CHANGES[1:5]} for r in self.ranges if r["lo"] <= version < r["hi"]]


class AsOfMatcher(Matcher):
    """Every occurrence of the words that are in the bank in the row's version (a column of the texts)."""

    name = "keyword"

    def __init__(self, history: BankHistory, version: Column):
        self.version = version
        self.table = GramTable(history.ranges, [("lo", "int"), ("hi", "int")]) if history.ranges else None

    def hits(self, text: Column, ord_: int) -> Column:
        if self.table is None:
            return empty_hits()
        found = self.table.occurrences(text, lambda w, at: hit_struct(ord_, self.name, w["word"], w["type"], w["severity"], at, w["n"]),
                                       lambda w, _: (w["lo"] <= self.version) & (self.version < w["hi"]))
        return F.coalesce(found, empty_hits())


def moderate_as_of(texts: DataFrame, history: BankHistory, ts_col: str = "ts", others: Iterable = (), keep: tuple = (), **kw) -> DataFrame:
    """``moderate`` with the bank of each text's time, then the matchers ``others``; rows carry ``bank_version``.

    One projection: batch or stream alike. A text without a time is judged by the empty bank (its version is null).
    """
    texts = texts.withColumn("bank_version", history.version(micros(ts_col, texts.schema[ts_col].dataType)))
    matchers = [AsOfMatcher(history, F.coalesce("bank_version", F.lit(0))), *others]
    return moderate(texts, matchers, keep=("bank_version", *[k for k in keep if k != "bank_version"]), **kw)
