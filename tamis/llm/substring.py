"""Substring dedup by prefix-partitioned classes of anchored word windows (operator 5).

A window is ``length`` (13) consecutive words of one document. A word is removed when some
window that covers it also starts in a document with a smaller doc_id.

Method. Suffixes are split by prefixes into groups, each about the prefixes of ``group_bytes`` of
text. In a group, rank doubling gives the classes of equal windows, the nodes a suffix tree has
at depth ``length``; no tree is built. Of each class all but the windows of the smallest doc_id
are removed.

1. Blocks. The table is cut into blocks of at most ``block_rows`` documents with at most
   ``block_bytes`` of text (a longer text is a block of its own) and written once, bucketed
   by block, so later passes over it need no shuffle of texts.
2. Prefixes. Every window holds a unique anchor: the five-word prefix with the smallest hash
   in it (the leftmost of equals). Equal windows have the same anchor at the same place, so
   only suffixes at anchors (one word in five) are looked at. A block sends each distinct
   anchor once, packed by group, with the numbers of its documents and places; a group answers
   with a byte per anchor: not shared, shared, or hot (over ``hot`` places, in one document
   or in many).
3. Groups. For a shared prefix, a block sends each occurrence with the words of its windows.
   A hot prefix is extended to the whole window: a block sends each distinct window once,
   with its smallest doc_id, however often documents repeat it. So no group depends on how
   often a passage is copied, in one text or in many, only on how many blocks and different
   texts hold it.
4. Classes. A group ranks its suffixes by their first 1, 2, 4, 8 and 13 words (each rank from
   two shorter ones). Suffixes of equal last rank are one class. The group answers with
   the suffixes to remove, or with the smallest doc_id of each hot window.
5. Each block marks the covered words and joins the rest.

Words are compared by 64-bit hashes, 13 of them to a window. Only positions and hashes meet in
groups; nothing of the corpus goes through the driver.

Edge cases. A null text counts as no words. Windows never cross documents; shorter documents
lose nothing. Rows that repeat a doc_id do not remove each other's words (none is smaller).
A null doc_id counts as larger than all others. An empty table gives an empty result. Texts
without a removed word are returned unchanged by ``remove_repeats``; others as their kept
words joined by a space. Extra columns are kept by ``remove_repeats``; columns named like its
results are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tamis.llm.frames import ship, total_bytes, write_blocks
from tamis.llm.words import Words, grams, hash_spans, mix, word_hashes, words

_NONE = np.iinfo(np.int64).max


def _ids(column) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_NONE).to_numpy(zero_copy_only=False).astype(np.int64)


class Anchors:
    """The anchored windows of a block's documents.

    A run is the windows of one document that share an anchor: they start at words
    ``first`` to ``first + n - 1``, and their anchor is the prefix at word ``at``.
    """

    def __init__(self, column, length: int, prefix: int):
        self.w: Words = words(column)
        self.h = word_hashes(self.w)
        self.length, self.prefix = length, prefix
        g = grams(self.h, prefix)
        m = len(self.h) - length + 1
        empty = np.zeros(0, np.int64)
        if m <= 0:
            self.first, self.n, self.at, self.key, self.row = empty, empty, empty, np.zeros(0, np.uint64), empty
            return
        span = length - prefix + 1
        low = g[:m].copy()
        for j in range(1, span):
            np.minimum(low, g[j:m + j], out=low)
        at = np.zeros(m, dtype=np.int64)
        for j in range(span - 1, -1, -1):
            hit = g[j:m + j] == low
            at[hit] = np.flatnonzero(hit) + j
        start = np.flatnonzero(self.w.row[:m] == self.w.row[length - 1:])
        at = at[start]
        new = np.ones(len(start), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
        where = np.flatnonzero(new)
        self.first = start[where]
        self.n = np.diff(np.append(where, len(start)))
        self.at = at[where]
        self.key = g[self.at]
        self.row = self.w.row[self.first]

    def counts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct prefixes, the number of doc_ids that hold each, and the number of runs that do."""
        order = np.lexsort((ids[self.row], self.key))
        k, d = self.key[order], ids[self.row][order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = k[1:] != k[:-1]
        fresh_doc = new.copy()
        fresh_doc[1:] |= d[1:] != d[:-1]
        where = np.flatnonzero(new)
        runs = np.diff(np.append(where, len(k)))
        return k[where], np.add.reduceat(fresh_doc.astype(np.int64), where) if len(where) else where, runs


def _pack(*arrays) -> bytes:
    raw = b"".join(len(b).to_bytes(8, "little") + b for b in (np.ascontiguousarray(a).tobytes() for a in arrays))
    return pa.compress(raw, codec="zstd", asbytes=True) + len(raw).to_bytes(8, "little")


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = pa.decompress(blob[:-8], decompressed_size=int.from_bytes(blob[-8:], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    for k in kinds:
        n = int.from_bytes(raw[at:at + 8], "little")
        out.append(np.frombuffer(raw[at + 8:at + 8 + n], dtype=k))
        at += 8 + n
    return out


def _groups(key: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Indices of the keys by group."""
    g = (key % np.uint64(n)).astype(np.int64)
    order = np.argsort(g, kind="stable")
    cut = np.flatnonzero(np.diff(g[order])) + 1
    return g, [(int(g[x[0]]), x) for x in np.split(order, cut) if len(x)]


_MESSAGE = pa.schema([("grp", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
_MESSAGE_SQL = "grp long, block long, kind int, payload binary"


def _messages(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [()] * 4
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, _MESSAGE.types)], schema=_MESSAGE)


def _send_prefixes(length: int, prefix: int, groups: int):
    def run(key, t):
        k, n, runs = Anchors(t.column("text"), length, prefix).counts(_ids(t.column("doc_id").combine_chunks()))
        n, runs = (np.minimum(v, 65535).astype(np.uint16) for v in (n, runs))  # far over any ``hot``
        return _messages([(g, key[0].as_py(), 0, _pack(k[x], n[x], runs[x])) for g, x in _groups(k, groups)[1]])
    return run


def _answer_prefixes(hot: int):
    def run(key, t):
        parts = [_unpack(b, np.uint64, np.uint16, np.uint16) for b in t.column("payload").to_pylist()]
        _, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        docs, runs = (np.bincount(at, weights=np.concatenate([p[i] for p in parts]))[at] for i in (1, 2))
        state = np.where(docs > 1, np.where(runs > hot, 2, 1), 0).astype(np.uint8)
        cut = np.cumsum([len(p[0]) for p in parts])[:-1]
        return _messages([(key[0].as_py(), b, 1, _pack(p[0][s > 0], s[s > 0]))
                          for b, p, s in zip(t.column("block").to_pylist(), parts, np.split(state, cut)) if s.any()])
    return run


def _window_keys(a: Anchors) -> np.ndarray:
    return mix(grams(a.h, a.length) ^ np.uint64(0xA5A5A5A5A5A5A5A5))


def _starts(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The window starts of runs, and the run of each."""
    run = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[run], run


def _send_suffixes(length: int, prefix: int, groups: int):
    def run(key, left, right):
        if not left.num_rows or not right.num_rows:
            return _messages([])
        ids = _ids(left.column("doc_id").combine_chunks())
        a = Anchors(left.column("text"), length, prefix)
        parts = [_unpack(b, np.uint64, np.uint8) for b in right.column("payload").to_pylist()]
        k, s = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(k)
        k, s = k[order], s[order]
        at = np.minimum(np.searchsorted(k, a.key), len(k) - 1)
        state = np.where(k[at] == a.key, s[at], 0)
        out, block = [], key[0].as_py()
        cold = np.flatnonzero(state == 1)
        for g, x in _groups(a.key[cold], groups)[1]:
            x = cold[x]
            lo, hi = a.first[x], a.first[x] + a.n[x] - 1 + length  # the words of the run's windows
            text = b"\n".join(a.w.data[p:q].tobytes() for p, q in zip(a.w.start[lo].tolist(), a.w.end[hi - 1].tolist()))
            out.append((g, block, 2, _pack(a.key[x], ids[a.row[x]], a.row[x].astype(np.uint32),
                                           (a.first[x] - a.w.first[a.row[x]]).astype(np.uint32), a.n[x].astype(np.uint8),
                                           (a.at[x] - a.first[x]).astype(np.uint8), np.frombuffer(text, np.uint8))))
        hot = np.flatnonzero(state == 2)
        if len(hot):
            start, run_of = _starts(a.first[hot], a.n[hot])
            wk, doc = _window_keys(a)[start], ids[a.row[hot][run_of]]
            order = np.lexsort((doc, wk))
            wk, doc = wk[order], doc[order]
            one = np.ones(len(wk), dtype=bool)
            one[1:] = wk[1:] != wk[:-1]
            wk, doc = wk[one], doc[one]
            for g, x in _groups(wk, groups)[1]:
                out.append((g, block, 3, _pack(wk[x], doc[x])))
        return _messages(out)
    return run


def suffix_tree_nodes(h: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """The tree node at depth ``length`` of each suffix: equal numbers, equal first ``length`` words.

    ``h``: word hashes of all contexts one after the other. Ranks at depths 1, 2, 4, ... are
    those of the tree's inner nodes; the last step overlaps two of the deepest.
    """
    rank = np.unique(h, return_inverse=True)[1].astype(np.uint64)
    depth = 1
    while 2 * depth <= length:
        m = len(rank) - depth
        pair = (rank[:m] << np.uint64(32)) | rank[depth:]
        rank = np.concatenate([np.unique(pair, return_inverse=True)[1].astype(np.uint64), np.full(depth, len(pair), np.uint64)])
        depth *= 2
    pair = (rank[start] << np.uint64(32)) | rank[start + length - depth]
    return np.unique(pair, return_inverse=True)[1]


def _grow_trees(length: int):
    def run(key, t):
        kinds, blocks, blobs = t.column("kind").to_pylist(), t.column("block").to_pylist(), t.column("payload").to_pylist()
        out, group = [], key[0].as_py()
        cold = [(b, _unpack(p, np.uint64, np.int64, np.uint32, np.uint32, np.uint8, np.uint8, np.uint8)) for k, b, p in zip(kinds, blocks, blobs) if k == 2]
        if cold:
            doc, n = np.concatenate([p[1] for _, p in cold]), np.concatenate([p[4] for _, p in cold]).astype(np.int64)
            text = np.concatenate([x for _, p in cold for x in (p[6], np.array([10], np.uint8))])
            inside = words(pa.array([text.tobytes()], pa.binary()))
            h = hash_spans(inside.data, inside.start, inside.end)
            first = np.cumsum(n + length - 1) - (n + length - 1)
            start, run_of = _starts(first, n)
            node = suffix_tree_nodes(h, start, length)
            least = np.full(int(node.max()) + 1, _NONE, dtype=np.int64)
            np.minimum.at(least, node, doc[run_of])
            gone = doc[run_of] > least[node]
            block_of = np.repeat(np.arange(len(cold)), [len(p[1]) for _, p in cold])[run_of]
            row, word = np.concatenate([p[2] for _, p in cold]), np.concatenate([p[3] for _, p in cold])
            at = word[run_of] + (start - first[run_of]).astype(np.uint32)
            for i in np.unique(block_of[gone]):
                x = np.flatnonzero(gone & (block_of == i))
                out.append((group, cold[i][0], 4, _pack(row[run_of[x]], at[x])))
        hot = [(b, _unpack(p, np.uint64, np.int64)) for k, b, p in zip(kinds, blocks, blobs) if k == 3]
        if hot:
            wk, doc = np.concatenate([p[0] for _, p in hot]), np.concatenate([p[1] for _, p in hot])
            seen, at = np.unique(wk, return_inverse=True)
            least = np.full(len(seen), _NONE, dtype=np.int64)
            np.minimum.at(least, at, doc)
            for b, p in hot:
                out.append((group, b, 5, _pack(p[0], least[np.searchsorted(seen, p[0])])))
        return _messages(out)
    return run


def _mark(length: int, prefix: int, text_name: str, schema: pa.Schema):
    def run(key, left, right):
        t = left.select([n for n in left.column_names if n in schema.names])
        ids = _ids(left.column("doc_id").combine_chunks())
        a = Anchors(left.column("text"), length, prefix)
        cover = np.zeros(len(a.h) + 1, dtype=np.int64)
        for kind, blob in zip(right.column("kind").to_pylist(), right.column("payload").to_pylist()):
            if kind == 4:
                row, at = _unpack(blob, np.uint32, np.uint32)
                start = a.w.first[row] + at
                np.add.at(cover, start, 1)
                np.add.at(cover, start + length, -1)
        hot = [_unpack(b, np.uint64, np.int64) for k, b in zip(right.column("kind").to_pylist(), right.column("payload").to_pylist()) if k == 5]
        if hot:
            wk, least = np.concatenate([p[0] for p in hot]), np.concatenate([p[1] for p in hot])
            order = np.argsort(wk)
            wk, least = wk[order], least[order]
            start, _ = _starts(a.first, a.n)
            mine = _window_keys(a)[start]
            at = np.minimum(np.searchsorted(wk, mine), len(wk) - 1)
            start = start[(wk[at] == mine) & (ids[a.w.row[start]] > least[at])]
            np.add.at(cover, start, 1)
            np.add.at(cover, start + length, -1)
        keep = np.cumsum(cover[:-1]) == 0
        n = np.diff(a.w.first)
        kept = np.add.reduceat(np.append(keep, 0).astype(np.int64), a.w.first[:-1]) if len(n) else n
        kept = np.where(n > 0, kept, 0)
        s, e = a.w.start.tolist(), a.w.end.tolist()
        data = a.w.data.tobytes()
        joined = []
        for i, (x, y) in enumerate(zip(a.w.first[:-1].tolist(), a.w.first[1:].tolist())):
            joined.append(b" ".join([data[s[j]:e[j]] for j in (np.flatnonzero(keep[x:y]) + x).tolist()]))
        more = {"n_words": pa.array(n, pa.int64()), "n_removed": pa.array(n - kept, pa.int64()), "kept_text": pa.array(joined, pa.binary()).cast(pa.string())}
        cols = [t.column(f.name).cast(f.type) if f.name in t.column_names else more[f.name] for f in schema]
        return pa.Table.from_arrays(cols, schema=schema)
    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 13, prefix: int = 5,
                   hot: int = 200, block_rows: int = 1024, block_bytes: int = 3 << 20,
                   group_bytes: int = 6 << 20) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (the words that stay, joined by one space)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("n_words", "n_removed", "kept_text")
    own = [c for c in docs.columns]
    names = {c: f"c{i}" for i, c in enumerate(own)}  # inner names, so that none clashes
    rows = docs.select(docs["`" + id_col + "`"].cast("long").alias("doc_id"), docs["`" + text_col + "`"].cast("string").alias("text"),
                       *[docs["`" + c.replace("`", "``") + "`"].alias(k) for c, k in names.items() if c not in (id_col, text_col)])
    blocks = write_blocks(rows, "text", block_rows, block_bytes)
    text = blocks.select("block", "doc_id", "text")
    groups = max(8, -(-total_bytes(blocks, "text")[1] // group_bytes))  # about the prefixes of group_bytes of text in a group
    asked = text.groupBy("block").applyInArrow(_send_prefixes(length, prefix, groups), _MESSAGE_SQL)
    states = asked.groupBy("grp").applyInArrow(_answer_prefixes(hot), _MESSAGE_SQL)
    sent = text.groupBy("block").cogroup(states.groupBy("block")).applyInArrow(_send_suffixes(length, prefix, groups), _MESSAGE_SQL)
    found = sent.groupBy("grp").applyInArrow(_grow_trees(length), _MESSAGE_SQL)
    result = blocks.drop("block").schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    from pyspark.sql.pandas.types import to_arrow_schema
    marked = blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_mark(length, prefix, text_col, to_arrow_schema(result)), result)
    back = {id_col: "doc_id", text_col: "text", **{c: k for c, k in names.items() if c not in (id_col, text_col)}}
    return marked.select(*[F.col(back[c]).cast(docs.schema[c].dataType).alias(c) for c in own], "n_words", "n_removed", "kept_text")


def substring_dedup(docs: DataFrame, **how) -> DataFrame:
    out = remove_repeats(docs.select("doc_id", "text"), **how)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
