"""Vectorised word spans and hashes over Arrow string columns (numpy, no per-word Python).

Two word definitions:

* ``space``: maximal runs of bytes other than space and 0x09-0x0D, i.e. ``[^\\x20\\x09-\\x0D]+``;
* ``alnum``: maximal runs of ``0-9a-z`` (after lower-casing A-Z) and bytes >= 0x80, i.e.
  ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.

Both work on UTF-8 bytes: every separator is ASCII, so a character is never split.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.ones(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)
_LONG = 128  # words above this many bytes are hashed by blake2b


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (a bijection on 64-bit integers)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    base = int(offsets[0]) if len(offsets) else 0
    return data[base:int(offsets[-1]) if len(offsets) else 0], offsets - base


def slices(batch, column: str, max_bytes: int = 4 << 20):
    """Row ranges of a record batch or table holding about ``max_bytes`` of text each (one row at least)."""
    _, off = flat(batch.column(column))
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + max_bytes, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield batch.slice(i, j - i)
        i = j


@dataclass
class Words:
    data: np.ndarray      # bytes, lower-cased if asked
    offsets: np.ndarray   # row starts in data, one more than rows
    start: np.ndarray     # first byte of each word
    end: np.ndarray       # byte after each word
    row: np.ndarray       # row of each word
    first: np.ndarray     # index of each row's first word, one more than rows

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(column, table: np.ndarray = SPACE, lower: bool = False) -> Words:
    data, offsets = flat(column)
    if lower:
        data = LOWER[data]
    inside = table[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    before[cut] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    after[cut[cut > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, start, end, row, first)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes at a time over all spans still open."""
    length = (end - start).astype(np.int64)
    h = mix(length.astype(np.uint64) * _M1 + np.uint64(seed))
    if not len(start):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    todo = np.flatnonzero(length <= _LONG)
    at = 0
    while len(todo):
        left = length[todo] - at
        keep = np.minimum(left, 8)
        x = eight[start[todo] + at]
        x = np.where(keep == 8, x, x & ((np.uint64(1) << (keep.astype(np.uint64) * np.uint64(8))) - np.uint64(1)))
        y = (h[todo] ^ x) * _M2
        h[todo] = y ^ (y >> np.uint64(32))
        at += 8
        todo = todo[left > 8]
    for i in np.flatnonzero(length > _LONG):
        d = hashlib.blake2b(data[start[i]:end[i]].tobytes(), digest_size=8, salt=int(seed).to_bytes(8, "little")).digest()
        h[i] = np.uint64(int.from_bytes(d, "little"))
    return mix(h)


def word_hashes(w: Words, seed: int = 0) -> np.ndarray:
    return hash_spans(w.data, w.start, w.end, seed)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive words (rows are not looked at; mask them outside)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = h[:n].copy()
    for j in range(1, k):
        g = (g * _M1) ^ (g >> np.uint64(29))
        g += h[j:n + j]
    return mix(g)


def text_batch(ids, texts) -> pa.Table:
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())})
