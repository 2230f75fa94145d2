"""Regex matchers (M2, M3).

Patterns are config-size and known on the driver: each is rewritten from RE2 to
java.util.regex, compiled once on the driver to lint it, and placed in the plan as
a *literal*, so every task compiles it once. Per pattern and text: leftmost match
only, at most one hit; a zero-length match is a hit of length 0. Offsets count
characters: the prefix before the leftmost match is ``^((?s:.*?))(?:p)``, which
tries p at positions 0, 1, 2, ... exactly as a search does.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tamis.functions.dialect import free_of_context, literal_tail, prepare, required_literal, nested_quantifier
from tamis.operators.grams import GramTable, inlined
from tamis.functions.arrays import let
from tamis.operators.matchers import Matcher, bank_rows, hit_struct, empty_hits, _weight_of
from tamis.functions.text import weight_micros


class RegexMatcher(Matcher):
    """Each entry (name, pattern, type, severity, action) gives ≤ 1 hit per text.

    ``all_matches=True`` adds the count of non-overlapping matches per entry (P5, R).
    """

    name = "regex"

    def __init__(self, spark: SparkSession, entries: list[dict], name: str | None = None,
                 max_patterns: int = 50_000, unroll_max: int = 200, plan: str = "auto"):
        if name:
            self.name = name
        if len(entries) > max_patterns:
            raise ValueError(f"more than {max_patterns} patterns; split the pack")
        self.entries, self.skipped = [], []
        for e in entries:
            j = prepare(spark, e["pattern"])
            (self.entries if j is not None else self.skipped).append(
                dict(e, java=j, lit=required_literal(e["pattern"]) if j is not None else None))
        # lint: nested unbounded quantifiers can backtrack exponentially in Java (RE2 is linear)
        self.risky = [e["pattern"] for e in self.entries if nested_quantifier(e["pattern"])]
        if self.risky:
            import warnings
            warnings.warn(f"{len(self.risky)} pattern(s) with nested quantifiers may backtrack heavily on the JVM: "
                          f"{self.risky[:5]}")
        # up to ``unroll_max`` patterns: one literal expression each (compiled once per
        # task); beyond: the pack is a literal array, and an index from required literals to
        # patterns gives each text the patterns it can match at all: the literal occurs, and what the
        # pattern asks for behind it follows there
        self.packed = plan == "packed" or (plan == "auto" and len(self.entries) > unroll_max)
        if self.packed:
            fields = ("name", "type", "severity", "java", "pre")
            tails = [self._tail(spark, e) for e in self.entries]
            rows = [dict({f: e.get(f) for f in fields}, pre=None if free_of_context(e["pattern"]) else "^((?s:.*?))(?:" + e["java"] + ")", sure=sure) for e, (_, _, sure) in zip(self.entries, tails)]
            self.pack = F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), "array<struct<" + ",".join(f"{f}:string" for f in fields) + ",sure:boolean>>")
            named = [{"word": e["lit"], "at": i, "tail": tails[i][0]} for i, e in enumerate(self.entries) if e["lit"]]
            more = 4 * max([n for _, n, _ in tails], default=0)  # bytes that hold so many characters
            self.index = GramTable(named, [("at", "int"), ("tail", "string")], more) if named else None
            self.always = [i for i, e in enumerate(self.entries) if not e["lit"]]

    @staticmethod
    def _tail(spark, e: dict) -> tuple[str | None, int, bool]:
        """(Java pattern that must match where the literal begins, characters behind the literal, whether it is all of the pattern)."""
        tail = literal_tail(e["pattern"], e["lit"]) if e["lit"] else None
        java = prepare(spark, tail[0]) if tail else None
        return (None, 0, False) if java is None else ("^(?:" + java + ")", tail[1], tail[2])

    @classmethod
    def from_bank(cls, spark, bank, name: str = "regex", max_words: int = 50_000):
        """M2: the bank's words are the patterns; a hit's word is the pattern."""
        rows = bank_rows(bank, max_words)
        return cls(spark, [dict(name=r["word"], pattern=r["word"], type=r["type"], severity=r["severity"],
                                action=r.get("action")) for r in rows], name=name, max_patterns=max_words)

    @classmethod
    def from_rules(cls, spark, rules, name: str = "rules", max_rules: int = 50_000, plan: str = "auto"):
        """M3: a rule pack; a hit's word is the rule name."""
        if isinstance(rules, DataFrame):
            rows = [r.asDict() for r in rules.limit(max_rules + 1).collect()]
        else:
            rows = [dict(zip(("name", "pattern", "type", "severity", "action"), r)) if not isinstance(r, dict)
                    else r for r in rules]
        return cls(spark, rows, name=name, max_patterns=max_rules, plan=plan)

    @staticmethod
    def found(text: Column, e: dict) -> Column:
        """Leftmost-match test; a required literal is checked first with ``contains``."""
        m = text.rlike(e["java"])
        return (F.contains(text, F.lit(e["lit"])) & m) if e.get("lit") else m

    def _one(self, text: Column, e: dict, ord_: int) -> Column:
        p = e["java"]
        idx = F.length(F.regexp_extract(text, "^((?s:.*?))(?:" + p + ")", 1))
        ln = F.length(F.regexp_extract(text, p, 0))
        return F.when(self.found(text, e), hit_struct(ord_, self.name, F.lit(e["name"]), F.lit(e.get("type")),
                                                      F.lit(e.get("severity")), idx, ln))

    def candidates(self, text: Column) -> Column:
        """The pack's patterns that may match a text: those whose required literal occurs with the right text behind it, and those without one."""
        at = F.array(*[F.lit(i) for i in self.always]).cast("array<int>")
        if self.index is not None:
            fits = lambda w, c: w["tail"].isNull() | F.regexp(c["bytes"].cast("string"), w["tail"])
            named = F.array_distinct(self.index.occurrences(text, lambda w, _: w["at"], fits))
            at = F.array_sort(F.concat(F.coalesce(named, F.array().cast("array<int>")), at))
        return F.transform(at, lambda i: F.get(self.pack, i))

    def matching(self, text: Column) -> Column:
        """The candidates that match: the only regex runs over a text without hits."""
        return F.filter(self.candidates(text), lambda p: p["sure"] | F.regexp(text, p["java"]))

    def _packed_hit(self, text: Column, p: Column, ord_: int, first: Column) -> Column:
        """The hit whose characters are ``first``; without ``pre`` it begins where they first occur."""
        at = F.when(p["pre"].isNull(), F.call_function("instr", text, first) - 1).otherwise(F.length(F.call_function("regexp_extract", text, p["pre"], F.lit(1))))
        return hit_struct(ord_, self.name, p["name"], p["type"], p["severity"], at, F.length(first))

    def _packed_hits(self, text: Column, ord_: int) -> Column:
        return F.transform(self.matching(text), lambda p: let(F.call_function("regexp_extract", text, p["java"], F.lit(0)), lambda first: self._packed_hit(text, p, ord_, first)))

    def packed_counts(self, text: Column) -> Column:
        """array<struct<h, n_matches>> of the pack's patterns that match: one search of the text for all matches of a pattern."""
        found = F.transform(self.candidates(text), lambda p: F.struct(p.alias("p"), F.call_function("regexp_extract_all", text, p["java"], F.lit(0)).alias("all")))
        found = F.filter(found, lambda x: F.size(x["all"]) > 0)
        return F.transform(found, lambda x: F.struct(self._packed_hit(text, x["p"], 0, F.get(x["all"], 0)).alias("h"), F.size(x["all"]).cast("int").alias("n_matches")))

    def hits(self, text: Column, ord_: int) -> Column:
        if not self.entries:
            return empty_hits()
        if self.packed:
            return self._packed_hits(text, ord_)
        return F.filter(F.array(*[self._one(text, e, ord_) for e in self.entries]), lambda h: h.isNotNull())

    def first_hits(self, text: Column, ord_: int) -> Column:
        return self.hits(text, ord_)

    def score_micros(self, text: Column, weights: dict | None = None) -> Column:
        wm = weight_micros(weights)
        if self.packed:
            return F.aggregate(self._packed_hits(text, 0), F.lit(0).cast("long"),
                               lambda acc, h: acc + _weight_of(h["severity"], wm))
        out = F.lit(0).cast("long")
        for e in self.entries:
            w = wm.get(e.get("severity"), 0)
            if w:
                out = out + F.when(self.found(text, e), F.lit(w).cast("long")).otherwise(F.lit(0).cast("long"))
        return out

    def match_counts(self, text: Column) -> Column:
        """array<struct<word, n>>: non-overlapping match count per entry (0 included)."""
        if not self.entries:
            return F.expr("CAST(array() AS array<struct<word:string,n:int>>)")
        return F.array(*[F.struct(F.lit(e["name"]).alias("word"),
                                  F.size(F.regexp_extract_all(text, F.lit(e["java"]), F.lit(0))).cast("int").alias("n"))
                         for e in self.entries])

    def actions(self) -> dict:
        return {e["name"]: e.get("action") for e in self.entries}


def match_regex(spark, texts=None, bank=None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """M2 as flat HITS. ``match_regex(texts, bank)`` also works (session from ``texts``)."""
    if isinstance(spark, DataFrame):
        spark, texts, bank = spark.sparkSession, spark, texts
    tx = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return RegexMatcher.from_bank(spark, bank).flat_hits(tx, 0)


def match_rules(spark, texts=None, rules=None, id_col: str = "id", text_col: str = "text",
                all: bool = False, plan: str = "auto") -> DataFrame:
    """M3 as flat HITS; ``all=True`` adds ``n_matches`` (every non-overlapping match).
    ``match_rules(texts, rules)`` also works (session from ``texts``)."""
    if isinstance(spark, DataFrame):
        spark, texts, rules = spark.sparkSession, spark, texts
    m = RegexMatcher.from_rules(spark, rules, plan=plan)
    tx = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not all:
        return m.flat_hits(tx, 0)
    t = F.col("text")
    if m.packed:
        return inlined(tx, m.packed_counts(t), "n_matches").select("id", "h.*", "n_matches")
    arr = F.filter(F.array(*[
        F.when(m.found(t, e), F.struct(m._one(t, e, 0).alias("h"),
                                            F.size(F.regexp_extract_all(t, F.lit(e["java"]), F.lit(0)))
                                            .cast("int").alias("n_matches")))
        for e in m.entries]), lambda x: x.isNotNull()) if m.entries else \
        F.expr("CAST(array() AS array<struct<h:int,n_matches:int>>)")
    return inlined(tx, arr, "n_matches").select("id", "h.*", "n_matches")
