"""A gram index over a word bank, for banks too large to test word by word.

A word is indexed under its first bytes (8, 6, 4, 3, 2 or 1 of them, by its length), as one 64-bit number.
Matching has two steps:

1. ``candidates``: the positions of a text whose gram is in the index, by a bitmap over whole Arrow batches (numpy,
   no step per text or position). A candidate carries its character position, its gram and the bytes there.
2. Spark finds the words: an equality of grams, confirmed by the candidate's bytes beginning with the word. Small
   and middle banks are a literal hash table that expressions look up inside the row (``GramTable``: no join, no
   shuffle, the same in streams); larger ones are rows of an equi-join (``join_words``), broadcast while their number
   is within a checked bound, so that positions are not shuffled.

Every occurrence starts at exactly one position and has one gram, so it is found exactly once, overlapping and
nested ones too.
"""

from __future__ import annotations

import json
import sys as _sys
import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle as _cp
from pyspark.sql import Column, DataFrame, functions as F

from tamis.functions.arrays import let

# This module's code runs on Python workers; it is shipped by value with the task.
_cp.register_pickle_by_value(_sys.modules[__name__])

#: Bytes of a word that its gram takes: the largest of these that is not above its length.
GRAM_BYTES = (8, 6, 4, 3, 2, 1)
_SPREAD = 0x9E3779B97F4A7C15
_STEP = 1 << 18


def gram_of(word: bytes) -> tuple[int, int]:
    """(bytes taken, gram as a signed 64-bit number)."""
    b = next(b for b in GRAM_BYTES if b <= len(word))
    return b, int.from_bytes(word[:b].ljust(8, b"\0"), "little", signed=True)


class Filter:
    """Which positions of a text may begin a word: bitmaps of the grams, one per gram length.

    A position shows the bytes of the longest word of its class and ``more`` behind them.
    """

    def __init__(self, words: list[str], more: int = 0):
        by: dict[int, list[bytes]] = {}
        for w in words:
            raw = w.encode()
            by.setdefault(gram_of(raw)[0], []).append(raw)
        self.classes = [(b, np.unique(np.array([gram_of(w)[1] for w in ws], dtype=np.int64)), max(map(len, ws)) + more) for b, ws in sorted(by.items())]
        self._maps = None

    def __getstate__(self):
        return dict(self.__dict__, _maps=None)

    @staticmethod
    def _slot(grams: np.ndarray, n: int) -> np.ndarray:
        """Places in a bitmap of ``n`` (a power of two)."""
        return ((grams * np.uint64(_SPREAD)) >> np.uint64(65 - n.bit_length())).view(np.int64)

    def maps(self) -> list[np.ndarray]:
        if self._maps is None:
            self._maps = []
            for _, grams, _ in self.classes:
                m = np.zeros(1 << min(22, max(12, (16 * len(grams)).bit_length())), dtype=bool)  # a small one stays in cache
                m[self._slot(grams.view(np.uint64), len(m))] = True
                self._maps.append(m)
        return self._maps

    def positions(self, data: np.ndarray):
        """(byte positions, gram, its length, bytes to show) of each class; grams are looked up in the index itself at last."""
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        window = np.ndarray(shape=(len(data),), dtype="<u8", buffer=padded.data, strides=(1,))
        for (b, grams, most), m in zip(self.classes, self.maps()):
            mask = np.uint64((1 << (8 * b)) - 1)
            for i in range(0, len(data), _STEP):
                part = window[i:i + _STEP] & mask
                at = np.flatnonzero(m[self._slot(part, len(m))])
                g = part[at].view(np.int64)
                hit = grams[np.minimum(np.searchsorted(grams, g), len(grams) - 1)] == g
                yield at[hit] + i, g[hit], b, most


_CANDIDATE = pa.struct([("idx", pa.int32()), ("b", pa.int32()), ("gram", pa.int64()), ("bytes", pa.binary())])
_CANDIDATE_SQL = "array<struct<idx:int,b:int,gram:bigint,bytes:binary>>"


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets); null counts as empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def find_candidates(texts: pa.Array, grams: Filter) -> pa.ListArray:
    data, off = _flat(texts)
    found = list(grams.positions(data))
    if not found:
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(off), np.int32)), pa.array([], _CANDIDATE))
    at = np.concatenate([f[0] for f in found])
    order = np.argsort(at, kind="stable")
    at = at[order]
    gram = np.concatenate([f[1] for f in found])[order]
    b = np.concatenate([np.full(len(f[0]), f[2]) for f in found])[order]
    row = np.searchsorted(off, at, side="right") - 1
    size = np.minimum(np.concatenate([np.full(len(f[0]), f[3]) for f in found])[order], off[row + 1] - at)
    keep = size >= b  # a gram must not reach into the next text
    at, gram, b, row, size = at[keep], gram[keep], b[keep], row[keep], size[keep]
    before = np.cumsum((data & 0xC0) != 0x80, dtype=np.int64 if len(data) >> 31 else np.int32)  # characters up to and including each byte's
    idx = before[at] - before[np.minimum(off[row], len(data) - 1)]
    ends = np.cumsum(size)
    shown = data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + size, size)]
    shown = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(shown)])
    items = pa.StructArray.from_arrays([pa.array(idx, pa.int32()), pa.array(b, pa.int32()), pa.array(gram), shown.cast(pa.binary())], names=["idx", "b", "gram", "bytes"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(off))).astype(np.int32)), items)


def in_slices(texts: pa.Array, most: int = 1 << 20):
    """Consecutive parts of about ``most`` bytes (one text at least)."""
    _, off = _flat(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield texts.slice(i, j - i)
        i = j


def candidates_udf(words: list[str], more: int = 0):
    """Column function text -> array<struct<idx, b, gram, bytes>>.

    A batch's results leave slice by slice, so a worker holds the candidates of one slice and never those of a batch.
    """
    grams = Filter(words, more)

    @F.arrow_udf(_CANDIDATE_SQL)
    def candidates(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in in_slices(texts):
                yield find_candidates(part, grams)

    return candidates


def inlined(rows: DataFrame, items: Column, field: str, id_col: str = "id") -> DataFrame:
    """(id, the fields of ``items``), one row per item; ``field`` is never null in an item.

    An outer generator: for an inner one Spark puts a filter by the array's size in front, which works the array out a second time.
    """
    return rows.select(F.col(id_col).alias("id"), F.inline_outer(items)).where(F.col(field).isNotNull())


def pieces(text: Column, size: int, overlap: int) -> Column:
    """array<struct<off, n, ext>>: the text cut every ``size`` characters; ``ext`` has ``overlap - 1`` more of the next piece."""
    many = let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0)), lambda cs: F.transform(cs, lambda p, k: F.struct(
        (k * size).alias("off"), F.length(p).alias("n"),
        (F.concat(p, F.coalesce(F.substring(F.get(cs, k + 1), 1, overlap - 1), F.lit(""))) if overlap > 1 else p).alias("ext"))))
    one = F.array(F.struct(F.lit(0).alias("off"), F.length(text).alias("n"), text.alias("ext")))
    return F.when(F.length(text) <= size, one).otherwise(many)


class HashTable:
    """A config-size table as a literal: buckets by key, so a lookup inside a lambda costs a bucket, not the table.

    ``fields`` = [(name, sql type)], the first one the key: a string (dealt by crc32) or a long (by remainder). The
    literal is folded once from JSON text.
    """

    def __init__(self, rows: list[dict], fields: list[tuple[str, str]]):
        self.key, kind = fields[0]
        self.text_key = kind == "string"
        self.n = 2 * len(rows) | 1
        buckets: list[list[dict]] = [[] for _ in range(self.n)]
        for r in rows:
            k = r[self.key]
            buckets[(zlib.crc32(k.encode()) if self.text_key else k) % self.n].append({f: r.get(f) for f, _ in fields})
        ddl = "array<array<struct<" + ",".join(f"{n}:{t}" for n, t in fields) + ">>>"
        self.column = F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False, separators=(",", ":"))), ddl)

    def bucket(self, key: Column) -> Column:
        return F.get(self.column, F.pmod(F.crc32(key) if self.text_key else key, F.lit(self.n)).cast("int"))

    def found(self, key: Column) -> Column:
        """The rows whose key is ``key``, as an array."""
        return F.filter(self.bucket(key), lambda r: r[self.key] == key)


def _index(rows: list[dict], extra: list[tuple[str, str]] = ()) -> list[dict]:
    out = []
    for r in rows:
        b, gram = gram_of(r["word"].encode())
        out.append({"gram": gram, "b": b, "word": r["word"], "type": r.get("type"), "severity": r.get("severity"), "n": len(r["word"])}
                   | {f: r[f] for f, _ in extra})
    return out


_INDEX_SQL = [("gram", "bigint"), ("b", "int"), ("word", "string"), ("type", "string"), ("severity", "string"), ("n", "int")]


class GramTable:
    """Occurrences of bank words in a text column, inside one projection.

    Rows may repeat a word (with other ``extra`` fields); ``where(word row, candidate)`` then chooses among them,
    by the text behind the word too: a candidate's bytes have ``more`` of it.
    """

    def __init__(self, rows: list[dict], extra: list[tuple[str, str]] = (), more: int = 0):
        self.udf = candidates_udf(sorted({r["word"] for r in rows}), more)
        self.table = HashTable(_index(rows, extra), [*_INDEX_SQL, *extra])

    def occurrences(self, text: Column, hit, where=None) -> Column:
        """array of ``hit(word row, position)``, one per occurrence (of rows for which ``where`` holds)."""
        def is_at(w, c):
            found = (w["b"] == c["b"]) & F.startswith(c["bytes"], w["word"].cast("binary"))
            return found if where is None else found & where(w, c)

        def words_at(c):
            here = F.filter(self.table.found(c["gram"]), lambda w: is_at(w, c))
            return F.transform(here, lambda w: hit(w, c["idx"]))
        return F.flatten(F.transform(self.udf(text), words_at))


def join_words(texts: DataFrame, rows: list[dict], max_broadcast: int = 500_000) -> DataFrame:
    """(id, word, type, severity, idx, len): every occurrence, by an equi-join of candidates with the index.

    ``texts``: (id, text). The index has one row per word and is broadcast while there are at most ``max_broadcast``:
    candidates are not shuffled then. Beyond it both sides are shuffled by gram.
    """
    index = texts.sparkSession.createDataFrame([tuple(r[f] for f, _ in _INDEX_SQL) for r in _index(rows)], ", ".join(f"{n} {t}" for n, t in _INDEX_SQL))
    if len(rows) <= max_broadcast:
        index = F.broadcast(index)
    at = inlined(texts, candidates_udf([r["word"] for r in rows])(F.col("text")), "gram")
    here = at.join(index, ["gram", "b"]).where(F.startswith("bytes", F.col("word").cast("binary")))
    return here.select("id", "word", "type", "severity", "idx", F.col("n").alias("len"))
