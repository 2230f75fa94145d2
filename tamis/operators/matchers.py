"""Matcher protocol.

A *row matcher* turns a text column into an ``array<hit>`` column inside one
projection: no shuffle, no join, one pass over the scan. Verdict policies combine
the arrays of several matchers per row (see ``policy``). Matchers that need a join
(large banks) or user code give a flat HITS DataFrame instead (``flat_hits``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tamis import schemas
from tamis.functions.arrays import let
from tamis.functions.text import weight_micros


class BankTooLarge(Exception):
    pass


def bank_rows(bank, max_words: int = 200_000, max_chars: int = 20_000_000) -> list[dict]:
    """Bank rows on the driver, behind a size check; of a repeated word the last row counts.

    A bank is config-size; we fetch at most ``max_words + 1`` rows, so the driver
    never pulls more than the bound, and more rows than that are an error.
    ``bank``: a DataFrame, or a list of dicts, tuples or Rows.
    """
    if isinstance(bank, DataFrame):
        rows = [r.asDict() for r in bank.limit(max_words + 1).collect()]
    else:
        rows = [r if isinstance(r, dict) else r.asDict() if hasattr(r, "asDict")
                else dict(zip(("word", "type", "severity", "action"), r)) for r in bank]
    if len(rows) > max_words:
        raise BankTooLarge(f"bank has more than {max_words} words")
    if sum(len(r["word"] or "") for r in rows) > max_chars:
        raise BankTooLarge(f"bank words exceed {max_chars} characters")
    last = {r["word"]: r for r in rows if r.get("word")}
    return [last[w] for w in sorted(last)]


def empty_hits() -> Column:
    return F.expr(f"CAST(array() AS {schemas.HITS_DDL})")


def hit_struct(ord_: int, matcher: str, word, type_, severity, idx, length) -> Column:
    return F.struct(F.lit(ord_).cast("int").alias("matcher_ord"), F.lit(matcher).alias("matcher"),
                    word.alias("word"), type_.alias("type"), severity.alias("severity"),
                    idx.cast("int").alias("idx"), length.cast("int").alias("len"))


def first_per_word(hits: Column) -> Column:
    """The hit of each word with the lowest position (then the shortest)."""
    keyed = F.array_sort(F.transform(hits, lambda h: F.struct(h["word"].alias("k"), h["idx"].alias("i"), h["len"].alias("l"), h.alias("h"))))
    return let(keyed, lambda srt: F.transform(F.filter(srt, lambda x, i: (i == 0) | (F.get(srt, i - 1)["k"] != x["k"])), lambda x: x["h"]))


class Matcher:
    """Base class: subclasses give ``hits``; the rest has defaults."""

    name = "matcher"
    row_based = True

    def hits(self, text: Column, ord_: int) -> Column:  # array<hit>, every hit
        raise NotImplementedError

    def first_hits(self, text: Column, ord_: int) -> Column:
        """At most one hit per word: the lowest position (then shortest)."""
        return first_per_word(self.hits(text, ord_))

    def score_micros(self, text: Column, weights: dict | None = None) -> Column:
        wm = weight_micros(weights)
        return F.aggregate(self.hits(text, 0), F.lit(0).cast("long"),
                           lambda acc, h: acc + _weight_of(h["severity"], wm))

    def actions(self) -> dict:
        return {}

    def flat_hits(self, texts: DataFrame, ord_: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
        """Flat HITS rows (id, matcher, matcher_ord, word, type, severity, idx, len)."""
        from tamis.operators.grams import inlined
        return inlined(texts, self.hits(F.col(text_col), ord_), "matcher_ord", id_col).select(*schemas.HITS.fieldNames())


def _weight_of(sev: Column, wm: dict) -> Column:
    out = None
    for k, v in wm.items():
        out = F.when(sev == k, F.lit(v).cast("long")) if out is None else out.when(sev == k, F.lit(v).cast("long"))
    return F.lit(0).cast("long") if out is None else out.otherwise(F.lit(0).cast("long"))
