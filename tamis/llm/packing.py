"""Bounded-space online packing of tokenised documents (operator 6).

Method. Each partition keeps at most ``open_windows`` open windows of ``window`` tokens and
reads its documents once, in order. A document of a window or more gives whole windows at
once; the rest is placed best-fit: into the open window with the least room that holds it.
When none fits and no more may be opened, the fullest window is completed with the head of
the document and emitted, and the tail is placed again, so an emitted window has no padding.
At the end each partition leaves its partly filled windows. These leftovers (at most
``open_windows`` per partition, whatever the partition holds) are merged in groups of 64
partitions, then 64 groups, and so on: each merge fills windows one after the other and
passes on the last one only. One window of the whole corpus may be partly filled.

The first pass is written to the shared folder, so the corpus is tokenised once and a lost
executor costs its own tasks only. Sequence ids hold the partition (or merge) number and a
counter in it, and so are unique without coordination.

Edge cases. A null text counts as empty: the end token only. A document of any length is
packed whole, over as many sequences as it needs. Repeated rows are packed each; a null
doc_id stays null. An empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tamis.llm.encodings import encoding, vocabulary_path
from tamis.llm.frames import materialize, ship

_FAN = 64
_ROOM = 33  # bits of the counter in a sequence id
_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, closed boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("closed", pa.bool_())])
#: The special token of byte_bpe_50k (fixed value of the vocabulary).
END_OF_TEXT = ("<|endoftext|>", 50256)


class Packer:
    """Open windows and the rows they give. A window is (used, pieces)."""

    def __init__(self, window: int, open_windows: int, base: int):
        self.window, self.most, self.base, self.n = window, open_windows, base, 0
        self.order: list[tuple[int, int]] = []   # (room, number) of open windows, least room first
        self.open: dict[int, list] = {}
        self.rows: list[tuple] = []

    def _new(self) -> int:
        self.n += 1
        return self.base + self.n - 1

    def _emit(self, number: int, pieces: list, closed: bool) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids) // 4, ids, total, number, at, closed))
            at += len(ids) // 4

    def _put(self, i: int, piece: tuple) -> None:
        room, number = self.order.pop(i)
        self.open[number].append(piece)
        room -= len(piece[2]) // 4
        if room:
            bisect.insort(self.order, (room, number))
        else:
            self._emit(number, self.open.pop(number), True)

    def add(self, doc, ids: bytes) -> None:
        total, w = len(ids) // 4, self.window
        start = 0
        while total - start >= w:
            self._emit(self._new(), [(doc, start, ids[4 * start:4 * (start + w)], total)], True)
            start += w
        while start < total:
            need = total - start
            i = bisect.bisect_left(self.order, (need, -1))
            if i < len(self.order):
                self._put(i, (doc, start, ids[4 * start:], total))
                return
            if len(self.order) < self.most:
                number = self._new()
                self.open[number] = [(doc, start, ids[4 * start:], total)]
                bisect.insort(self.order, (w - need, number))
                return
            room = self.order[0][0]
            self._put(0, (doc, start, ids[4 * start:4 * (start + room)], total))
            start += room

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows

    def finish(self) -> list[tuple]:
        for _, number in self.order:
            self._emit(number, self.open[number], False)
        return self.take()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW.types)], schema=_ARROW)


def _first_pass(path: str, window: int, open_windows: int, end_id: int, special):
    def run(batches):
        enc = encoding(path, special)
        end = np.array([end_id], dtype="<u4").tobytes()
        packer = Packer(window, open_windows, TaskContext.get().partitionId() << _ROOM)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array(enc.encode(text, allowed_special="all"), dtype="<u4").tobytes() if text else b""
                packer.add(doc, ids + end)
                if len(packer.rows) >= 4096:
                    yield _batch(packer.take())
        yield _batch(packer.finish())
    return run


def _merge(window: int, level: int, last: bool):
    def run(key, t):
        t = t.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        base = (level << 56) | (key[0].as_py() << _ROOM)
        n, used, rows = 0, 0, []
        cols = [t.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")]
        begun = 0
        for doc, start, ids, total in zip(*cols):
            while ids:
                part = ids[:4 * (window - used)]
                rows.append([doc, start, len(part) // 4, part, total, base + n, used, False])
                used += len(part) // 4
                start += len(part) // 4
                ids = ids[len(part):]
                if used == window:
                    for r in rows[begun:]:
                        r[-1] = True
                    begun, used, n = len(rows), 0, n + 1
        if last:
            for r in rows[begun:]:
                r[-1] = True
        return pa.Table.from_batches([_batch([tuple(r) for r in rows])])
    return run


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 2048,
                   open_windows: int = 64, end_id: int = 1, vocabulary: str | None = None,
                   special: tuple[tuple[str, int], ...] = (END_OF_TEXT,)) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian u32), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    ship(spark)
    path = vocabulary or vocabulary_path("byte_bpe_50k.tiktoken")
    rows = docs.select(docs["`" + id_col + "`"].cast("long").alias("doc_id"), docs["`" + text_col + "`"].cast("string").alias("text"))
    first = materialize(spark, rows.mapInArrow(_first_pass(path, window, open_windows, end_id, special), _SCHEMA), "packed")
    out = first.where("closed")
    left = first.where("not closed").withColumn("_group", F.shiftright("sequence_id", _ROOM))
    top = left.agg(F.max("_group")).first()[0]
    level = 0
    while top is not None:
        level, top = level + 1, top // _FAN
        merged = left.withColumn("_group", F.expr(f"_group div {_FAN}")).groupBy("_group").applyInArrow(_merge(window, level, top == 0), _SCHEMA)
        merged = materialize(spark, merged, f"merged{level}")
        out = out.unionByName(merged.where("closed"))
        if top == 0:
            break
        left = merged.where("not closed").withColumn("_group", F.shiftright(F.col("sequence_id").bitwiseAND((1 << 56) - 1), _ROOM))
    return out.drop("closed")


def packing(docs: DataFrame, **how) -> DataFrame:
    """The pieces with ids_crc32 in place of their ids."""
    return pack_documents(docs, **how).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
