"""User-defined matchers (M5).

A matcher has a name and gives hits for texts. Two kinds:

* ``row_matcher(name, fn)``: ``fn(text) -> [(word, type, severity, idx, len), ...]``
  in plain Python, run as an Arrow UDF over slices of a batch. A row whose call raises
  gets no hits (the others go on), as the service skips a failing matcher.
* ``register_matcher(name, fn)`` with ``fn(texts_df, bank) -> HITS DataFrame``:
  a DataFrame-level matcher; policies over it use ``moderate_hits``.

Registering under a used name replaces it; an unknown name is an error.
"""

from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F

from tamis import fixed, schemas
from tamis.operators.grams import in_slices
from tamis.operators.matchers import Matcher

_REGISTRY: dict = {}

# Code of this module runs on Python workers; ship it by value with the task so the
# workers need not have the package installed.
import sys as _sys
from pyspark import cloudpickle as _cp
_cp.register_pickle_by_value(_sys.modules[__name__])


class MatcherNotFound(KeyError):
    pass


def register_matcher(name: str, matcher) -> None:
    """A matcher object, or a function ``fn(texts_df, bank) -> HITS`` (see ``DataFrameMatcher``)."""
    _REGISTRY[name] = matcher if isinstance(matcher, Matcher) else DataFrameMatcher(name, matcher)


def get_matcher(name: str):
    try:
        return _REGISTRY[name]
    except KeyError:
        raise MatcherNotFound(fixed.MSG_MATCHER_NOT_FOUND) from None


def registered() -> list[str]:
    return sorted(_REGISTRY)


class PythonRowMatcher(Matcher):
    """A per-text Python function as a row matcher (Arrow UDF).

    A batch becomes Python strings and hits slice by slice, so a worker holds those of one slice. The UDF returns finished hit structs (and, for ``first_hits``, keeps the first
    hit per word itself), so no Python call sits inside a higher-order function.
    """

    def __init__(self, name: str, fn):
        self.name = name
        self.fn = fn
        self._udfs = {}
        from pyspark import SparkContext
        # rows whose call raised (an accumulator: a retried task may count twice)
        self.errors = SparkContext.getOrCreate().accumulator(0)

    def _udf(self, ord_: int, first: bool):
        key = (ord_, first)
        if key in self._udfs:
            return self._udfs[key]
        fn_, name, errors = self.fn, self.name, self.errors

        kind = pa.list_(pa.struct([("matcher_ord", pa.int32()), ("matcher", pa.string()), ("word", pa.string()), ("type", pa.string()),
                                   ("severity", pa.string()), ("idx", pa.int32()), ("len", pa.int32())]))

        def found(t):
            hs = [(w, ty, sv, int(i), int(n)) for (w, ty, sv, i, n) in fn_(t) or []]
            if first:
                best = {}
                for h in hs:
                    if h[0] not in best or (h[3], h[4]) < (best[h[0]][3], best[h[0]][4]):
                        best[h[0]] = h
                hs = list(best.values())
            return [{"matcher_ord": ord_, "matcher": name, "word": w, "type": ty, "severity": sv,
                     "idx": i, "len": n} for (w, ty, sv, i, n) in hs]

        @F.arrow_udf(schemas.HITS_DDL)
        def _run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                for part in in_slices(texts):
                    out = []
                    failed = 0
                    for t in part:
                        try:
                            out.append([] if t.as_py() is None else found(t.as_py()))
                        except Exception:
                            out.append([])  # a failing matcher is skipped for this text
                            failed += 1
                    if failed:
                        errors.add(failed)
                    yield pa.array(out, kind)

        self._udfs[key] = _run
        return _run

    def hits(self, text: Column, ord_: int) -> Column:
        return self._udf(ord_, False)(text)

    def first_hits(self, text: Column, ord_: int) -> Column:
        return self._udf(ord_, True)(text)


class DataFrameMatcher(Matcher):
    """A DataFrame-level matcher: ``fn(texts_df, bank) -> HITS`` with at least
    (id, word, type, severity, idx, len). Policies over it aggregate (flat path)."""

    row_based = False

    def __init__(self, name: str, fn, bank=None):
        self.name, self.fn, self.bank = name, fn, bank

    def hits(self, text: Column, ord_: int) -> Column:
        raise TypeError("a DataFrame matcher gives a HITS table, not a column")

    def flat_hits(self, texts, ord_: int, id_col: str = "id", text_col: str = "text"):
        tx = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        h = self.fn(tx, self.bank)
        return h.select("id", F.lit(self.name).alias("matcher"), F.lit(ord_).cast("int").alias("matcher_ord"),
                        "word", "type", "severity", F.col("idx").cast("int"), F.col("len").cast("int"))


def dataframe_matcher(name: str, fn, bank=None, register: bool = True) -> DataFrameMatcher:
    m = DataFrameMatcher(name, fn, bank)
    if register:
        register_matcher(name, m)
    return m


def row_matcher(name: str, fn, register: bool = True) -> PythonRowMatcher:
    m = PythonRowMatcher(name, fn)
    if register:
        register_matcher(name, m)
    return m


def python_find_matcher(bank_rows: list[tuple], name: str = "python_find"):
    """A row matcher in plain Python: the first ``str.find`` of each word."""
    rows = [tuple(r[:3]) for r in bank_rows]

    def fn(text: str):
        out = []
        for w, ty, sv in rows:
            i = text.find(w)
            if i >= 0:
                out.append((w, ty, sv, i, len(w)))
        return out

    return row_matcher(name, fn)
