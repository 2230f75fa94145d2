"""Scalar text functions (T1-T6) as Catalyst expressions — no Python UDFs.

Offsets and lengths count characters (code points), 0-based.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tamis import fixed


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def mask(text, start, end) -> Column:
    """Replace characters [start, end) by '*'; start<0 -> 0, end>len -> len; empty range -> unchanged."""
    t = _col(text)
    n = F.length(t)
    s = F.greatest(_lit(start).cast("int"), F.lit(0))
    e = F.least(_lit(end).cast("int"), n)
    masked = F.concat(t.substr(F.lit(1), s), F.repeat(F.lit("*"), e - s),
                      t.substr(e + 1, F.greatest(n - e, F.lit(0))))
    return F.when(s >= e, t).otherwise(masked)


def contains_any(text, words) -> Column:
    """True if any word is a substring; an empty list gives false, an empty word matches."""
    t = _col(text)
    if isinstance(words, Column):
        return F.coalesce(F.exists(words, lambda w: F.contains(t, w)), F.lit(False))
    words = list(words)
    if not words:
        return F.when(t.isNull(), F.lit(None).cast("boolean")).otherwise(F.lit(False))
    out = None
    for w in words:
        c = F.contains(t, F.lit(w))
        out = c if out is None else (out | c)
    return out


def _fullwidth_tables() -> tuple[str, str]:
    src = "".join(chr(c) for c in range(fixed.FULLWIDTH_FIRST, fixed.FULLWIDTH_LAST + 1))
    dst = "".join(chr(c - fixed.FULLWIDTH_OFFSET) for c in range(fixed.FULLWIDTH_FIRST, fixed.FULLWIDTH_LAST + 1))
    # the zero-width space goes last and has no partner, so translate deletes it
    return src + fixed.IDEOGRAPHIC_SPACE + fixed.ZERO_WIDTH_SPACE, dst + " "


def normalize(text) -> Column:
    """Full-width ASCII -> half-width, ideographic space -> ' ', zero-width space removed."""
    src, dst = _fullwidth_tables()
    return F.translate(_col(text), src, dst)


def first_match(text, words) -> Column:
    """struct<idx:int, word:string>: lowest 0-based position over the words; ties go to the
    earlier word; none -> (-1, '')."""
    t = _col(text)
    if not isinstance(words, Column):
        words = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    cand = F.transform(words, lambda w, i: F.struct((F.instr(t, w) - 1).cast("int").alias("idx"),
                                                    i.alias("ord"), w.alias("word")))
    best = F.array_min(F.filter(cand, lambda x: x["idx"] >= 0))
    return F.struct(F.coalesce(best["idx"], F.lit(-1)).alias("idx"),
                    F.coalesce(best["word"], F.lit("")).alias("word"))


def is_ascii(text) -> Column:
    """No code point above 127 (UTF-8 byte count equals character count); '' -> true."""
    t = _col(text)
    return F.octet_length(t) == F.length(t)


def severity_weight(sev, weights: dict | None = None) -> Column:
    """high 1.0, medium 0.5, low 0.2, anything else 0.0 (or a caller's map)."""
    w = fixed.SEVERITY_WEIGHTS if weights is None else weights
    s = _col(sev)
    out = None
    for k, v in w.items():
        out = F.when(s == k, F.lit(float(v))) if out is None else out.when(s == k, F.lit(float(v)))
    return F.lit(0.0) if out is None else out.otherwise(F.lit(0.0))


def weight_micros(weights: dict | None = None) -> dict:
    """Weights as integer millionths, so sums are exact and order-free."""
    w = fixed.SEVERITY_WEIGHTS if weights is None else weights
    return {k: int(round(float(v) * 1_000_000)) for k, v in w.items()}

