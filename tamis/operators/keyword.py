"""Keyword matchers over a word bank.

M1 ``KeywordMatcher``: every occurrence of every bank word, overlapping and nested
occurrences included, exact and case-sensitive, offsets in characters.

Plan A (bank up to ``inline_max`` words): the bank is one
folded ``array<struct>`` literal in the plan (shipped with the task binary, like a
broadcast). Per text, ``filter(bank, contains(text, word))`` keeps the words that
occur; for those, ``split(text, '(?=word)')`` cuts the text at every occurrence
start (the lookahead also finds overlaps) and the piece lengths' prefix sums are
the offsets. One projection over the scan: no join, no shuffle.

Larger banks go through a gram index (``grams``): a vectorised filter leaves the positions where a word may
begin, and Spark finds the words there. Plan "gram" looks them up in a literal table inside the row, so
verdicts, hits, redaction, declared actions and streams work as with plan A. Plan "join" (more than
``table_max`` words) is an equi-join with the index, and gives a HITS table.

M4 ``LiteralMatcher``: the first occurrence of each word, at most one hit per word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tamis import schemas
from tamis.operators.grams import GramTable, inlined, join_words, pieces
from tamis.functions.arrays import exclusive_prefix_sum, let
from tamis.functions.sqlutil import literal_rows
from tamis.operators.matchers import Matcher, bank_rows, empty_hits, first_per_word, hit_struct, _weight_of
from tamis.functions.text import weight_micros

_FIELDS = [("word", "string"), ("type", "string"), ("severity", "string"), ("action", "string"),
           ("wlen", "int"), ("pat", "string")]


def java_quote(s: str) -> str:
    """A java.util.regex literal for ``s``."""
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def lookahead_pattern(word: str) -> str:
    return "(?=" + java_quote(word) + ")"


def occurrences(text: Column, word: Column, pat: Column) -> Column:
    """0-based character offsets of every (overlapping) occurrence of ``word``.

    ``pat`` is the lookahead pattern of ``word``. Java's split drops the empty piece
    of a zero-width match at position 0, so the first piece starts at 0 either way;
    when the text starts with the word, that start is an occurrence too.
    """
    starts = exclusive_prefix_sum(F.transform(F.split(text, pat, -1), lambda p: F.length(p)))
    return let(starts, lambda st: F.when(F.startswith(text, word), st).otherwise(
        F.slice(st, 2, F.greatest(F.size(st) - 1, F.lit(0)))))


def count_occurrences(text: Column, word: Column, pat: Column) -> Column:
    n = F.size(F.split(text, pat, -1)) - 1 + F.when(F.startswith(text, word), 1).otherwise(0)
    return F.greatest(n, F.lit(0))


class KeywordMatcher(Matcher):
    """M1: every occurrence of every word.

    ``plan="auto"`` keeps banks of up to ``inline_max`` words as a literal of the plan ("inline"), looks up the words
    of banks of up to ``table_max`` in a literal gram table ("gram") and joins larger ones ("join"). A
    bank of more than ``max_words`` words is refused (``BankTooLarge``).
    """

    name = "keyword"

    def __init__(self, bank, max_words: int = 200_000, name: str | None = None, plan: str = "auto",
                 inline_max: int = 64, table_max: int = 20_000, text_chunk: int = 65536):
        if plan not in ("auto", "inline", "gram", "join"):
            raise ValueError("plan must be 'auto', 'inline', 'gram' or 'join'")
        if name:
            self.name = name
        self.rows = bank_rows(bank, max_words)
        self.text_chunk = max([text_chunk, *(len(r["word"]) for r in self.rows)])
        if plan == "auto":
            plan = "inline" if len(self.rows) <= inline_max else "gram" if len(self.rows) <= table_max else "join"
        self.plan = plan if self.rows else "inline"
        self.row_based = self.plan != "join"
        self.table = GramTable(self.rows) if self.plan == "gram" else None
        self.bank_lit = literal_rows([dict(r, wlen=len(r["word"]), pat=lookahead_pattern(r["word"])) for r in self.rows], _FIELDS) if self.plan == "inline" else None

    def _by_gram(self, text: Column, ord_: int) -> Column:
        if self.table is None:
            raise TypeError(f"a bank of {len(self.rows)} words gives a HITS table, not a column: use flat_hits or moderate")
        found = self.table.occurrences(text, lambda w, at: hit_struct(ord_, self.name, w["word"], w["type"], w["severity"], at, w["n"]))
        return F.coalesce(found, empty_hits())

    def _joined(self, tx: DataFrame, ord_: int) -> DataFrame:
        found = join_words(tx, self.rows).withColumns({"matcher": F.lit(self.name), "matcher_ord": F.lit(ord_).cast("int")})
        return found.select(*schemas.HITS.fieldNames())

    def flat_hits(self, texts: DataFrame, ord_: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
        tx = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        if self.plan == "join":
            return self._joined(tx, ord_)
        return Matcher.flat_hits(self, tx, ord_) if self.plan == "gram" else self._chunked_inline(tx, ord_)

    def actions(self) -> dict:
        return {r["word"]: r.get("action") for r in self.rows}

    def _chunked_inline(self, tx: DataFrame, ord_: int) -> DataFrame:
        """Flat plan A over bounded pieces: a text longer than ``text_chunk`` characters is
        cut (one regex pass) into pieces that overlap by the longest word minus one;
        a piece keeps the occurrences that start inside it. A giant text never
        becomes one giant hit array."""
        c = self.text_chunk
        w = max([len(r["word"]) for r in self.rows] or [1])
        ck = tx.select("id", F.inline(pieces(F.col("text"), c, w)))
        e = F.col("ext")
        own = F.filter(self.hits(e, ord_), lambda h: h["idx"] < F.col("n"))
        shifted = F.transform(own, lambda h: h.withField("idx", h["idx"] + F.col("off")))
        return inlined(ck, shifted, "matcher_ord").select(*schemas.HITS.fieldNames())

    def _found(self, t: Column) -> Column:
        return F.filter(self.bank_lit, lambda b: F.contains(t, b["word"]))

    def hits(self, text: Column, ord_: int) -> Column:
        if self.plan != "inline":
            return self._by_gram(text, ord_)
        name = self.name
        return F.flatten(F.transform(
            self._found(text),
            lambda b: F.transform(occurrences(text, b["word"], b["pat"]),
                                  lambda p: hit_struct(ord_, name, b["word"], b["type"], b["severity"],
                                                       p, b["wlen"]))))

    def first_hits(self, text: Column, ord_: int) -> Column:
        if self.plan != "inline":
            return Matcher.first_hits(self, text, ord_)
        name = self.name
        return F.transform(self._found(text),
                           lambda b: hit_struct(ord_, name, b["word"], b["type"], b["severity"],
                                                F.instr(text, b["word"]) - 1, b["wlen"]))

    def score_micros(self, text: Column, weights: dict | None = None) -> Column:
        if self.plan != "inline":
            return Matcher.score_micros(self, text, weights)
        wm = weight_micros(weights)
        live = F.filter(self.bank_lit, lambda b: (_weight_of(b["severity"], wm) != 0) & F.contains(text, b["word"]))
        return F.aggregate(live, F.lit(0).cast("long"),
                           lambda acc, b: acc + _weight_of(b["severity"], wm)
                           * count_occurrences(text, b["word"], b["pat"]).cast("long"))


class LiteralMatcher(KeywordMatcher):
    """M4: first occurrence of each word (``strings.Index`` semantics), ≤ 1 hit per word."""

    name = "literal"

    def hits(self, text: Column, ord_: int) -> Column:
        return self.first_hits(text, ord_)

    def first_hits(self, text: Column, ord_: int) -> Column:
        return super().first_hits(text, ord_) if self.plan == "inline" else first_per_word(self._by_gram(text, ord_))

    def _joined(self, tx: DataFrame, ord_: int) -> DataFrame:
        names = schemas.HITS.fieldNames()
        least = super()._joined(tx, ord_).groupBy("id", "word").agg(F.min(F.struct("idx", *[n for n in names if n not in ("id", "word", "idx")])).alias("h"))
        return least.select(*[F.col(n if n in ("id", "word") else f"h.{n}").alias(n) for n in names])

    def score_micros(self, text: Column, weights: dict | None = None) -> Column:
        if self.plan != "inline":
            return Matcher.score_micros(self, text, weights)
        wm = weight_micros(weights)
        return F.aggregate(self._found(text), F.lit(0).cast("long"),
                           lambda acc, b: acc + _weight_of(b["severity"], wm))

    def flat_hits(self, texts: DataFrame, ord_: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
        tx = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        return self._joined(tx, ord_) if self.plan == "join" else Matcher.flat_hits(self, tx, ord_)


# --------------------------------------------------------------------------- flat API

def _texts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def match_literal(texts: DataFrame, bank, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """M4 as a flat HITS DataFrame."""
    return LiteralMatcher(bank).flat_hits(_texts(texts, id_col, text_col), 0)


def match_keywords(texts: DataFrame, bank, plan: str = "auto", id_col: str = "id", text_col: str = "text",
                   max_words: int = 200_000, inline_max: int = 64) -> DataFrame:
    """M1 as a flat HITS DataFrame. ``plan``: "inline", "gram", "join" or "auto"."""
    tx = _texts(texts, id_col, text_col)
    return KeywordMatcher(bank, max_words=max_words, plan=plan, inline_max=inline_max).flat_hits(tx, 0)
