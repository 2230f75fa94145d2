"""Ranked lexical search by scanning the documents with an Aho-Corasick automaton (operator 13).

Method. The items' terms are known before any document is read, so no document index is built: an
automaton of all terms, each guarded by a separator on both sides, runs over every whole text and counts
the occurrences of the terms in it. Its outputs are term numbers, which map to the items holding the term.

Passes. (1) A scan gives one row per document: its number of terms n, the item terms it holds
and their counts; written to the shared folder, so texts are read once. (2) N, L and the document
frequencies are plain aggregates with partial sums. (3) A pass over the written counts adds up
the items' scores in each task and keeps each item's ``k`` best there; the rows of all tasks are ranked
in two steps, so that no window holds more than about the root of them per item.

Blocks. Items are independent, so they are dealt by hash into blocks of about ``block_bytes`` of
terms and postings. A block's automaton and postings are shipped with the task; one block is used
where all fit (measured by an aggregate before anything is collected), else documents are scanned
once per block. Neither items nor documents are cut.

Terms are the maximal runs of ASCII letters and digits and of bytes from 0x80 on, with A-Z lower-cased. Term
weights are floor(1000 ln((2N+2)/(2df+1))) in doubles, all else is integer arithmetic.

Edge cases. A null or empty text has no terms; it counts in neither N nor L. Rows that repeat a doc_id are
documents of their own; a null doc_id orders last. Item rows that share an item_id (null included) are one
item with the terms of all of them; items without terms have no rows. Long texts are scanned in pieces cut
at separators. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tamis.llm.frames import materialize, ship
from tamis.llm.words import flat, slices

#: Every byte of a term as it is compared (A-Z lower-cased); every separator as a space.
_BYTES = np.full(256, 0x20, dtype=np.uint8)
for _a, _b in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _BYTES[_a:_b] = np.arange(_a, _b)
_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)

_PIECE = 1 << 20
_COUNTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])
_COUNTS_SQL = "doc_id long, n long, terms array<int>, tfs array<long>"


def terms_of(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(compared bytes, row offsets, number of terms per row) of an Arrow string column."""
    data, offsets = flat(texts)
    data = _BYTES[data]
    inside = data != 0x20
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    head = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[head] = inside[head]
    return data, offsets, np.diff(np.searchsorted(np.flatnonzero(start), offsets))


def _distinct_terms(batches):
    """(item, term) of item texts, each term once per row."""
    for b in batches:
        data, offsets, _ = terms_of(b.column("text"))
        items, terms = [], []
        for i, item in enumerate(b.column("item_id").to_pylist()):
            found = set(data[offsets[i]:offsets[i + 1]].tobytes().split())
            items += [item] * len(found)
            terms += sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(terms, pa.binary())], names=["item_id", "term"])


@functools.lru_cache(maxsize=2)
def _automaton(terms: tuple[bytes, ...]):
    import ahocorasick
    a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for number, t in enumerate(terms):
        a.add_word(" " + t.decode("latin-1") + " ", number)  # one character per byte
    a.make_automaton()
    return a


def _pieces(raw: bytes):
    """The text between guards, in pieces cut at separators."""
    i = 0
    while i < len(raw):
        j = raw.find(b" ", i + _PIECE)
        j = len(raw) if j < 0 else j
        yield " " + raw[i:j].decode("latin-1") + " "
        i = j


def _scan(terms: tuple[bytes, ...]):
    number = itemgetter(1)

    def run(batches):
        a = _automaton(terms)
        for whole in batches:
            for b in slices(whole, "text"):
                data, offsets, n = terms_of(b.column("text"))
                found = []
                for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    c = Counter()
                    for piece in _pieces(data[i:j].tobytes()):
                        c.update(map(number, a.iter(piece)))
                    found.append(c)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array([list(c.keys()) for c in found], _COUNTS.types[2]),
                                                  pa.array([list(c.values()) for c in found], _COUNTS.types[3])], schema=_COUNTS)
    return run


class Best:
    """Each item's k best (score, doc) so far; ties to the smaller doc, null last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = [np.zeros(0, np.int64)] * items
        self.doc = [np.zeros(0, np.int64)] * items
        self.null = [np.zeros(0, bool)] * items
        self.least = np.ones(items, np.int64)  # what a newcomer must reach

    def add(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """scores: documents x items."""
        good = scores >= self.least[None, :]
        for i in np.flatnonzero(good.any(axis=0)):
            at = np.flatnonzero(good[:, i])
            s = np.concatenate([self.score[i], scores[at, i]])
            d = np.concatenate([self.doc[i], doc[at]])
            z = np.concatenate([self.null[i], null[at]])
            keep = np.lexsort((d, z, -s))[:self.k]
            self.score[i], self.doc[i], self.null[i] = s[keep], d[keep], z[keep]
            if len(keep) == self.k:
                self.least[i] = s[keep[-1]]


def _rank(weights: np.ndarray, postings: list[np.ndarray], items: int, n_docs: int, n_terms: int, k: int):
    """One row per item and task's k best: item, doc_id, score."""
    size = np.array([len(p) for p in postings], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    every = np.concatenate(postings) if postings else np.zeros(0, np.int64)
    rows = min(256, max(1, (1 << 21) // max(1, items)))

    def run(batches):
        best = Best(items, k)
        for whole in batches:
            for a in range(0, whole.num_rows, rows):
                b = whole.slice(a, rows)
                null = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                doc = b.column("doc_id").fill_null(0).to_numpy()
                m = np.array([50 + (50 * n * n_docs) // n_terms for n in b.column("n").to_pylist()], dtype=np.int64)
                held = b.column("terms").value_lengths().to_numpy()
                term, tf = b.column("terms").flatten().to_numpy(), b.column("tfs").flatten().to_numpy()
                at = np.repeat(np.arange(b.num_rows), held)
                part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[at]))
                each = size[term]
                one = np.repeat(np.arange(len(term)), each)
                item = every[np.arange(len(one)) - np.repeat(np.cumsum(each) - each, each) + begin[term][one]]
                scores = np.zeros(b.num_rows * items, np.int64)
                np.add.at(scores, at[one] * items + item, part[one])
                best.add(scores.reshape(b.num_rows, items), doc, null)
        n = [len(s) for s in best.score]
        docs = pa.array(np.concatenate(best.doc), pa.int64(), mask=np.concatenate(best.null))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(items), n), pa.int32()), docs, pa.array(np.concatenate(best.score), pa.int64())],
                                         names=["item", "doc_id", "score"])
    return run


def _top(found: DataFrame, keys: list[str], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def rank_documents(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", k: int = 50, block_bytes: int = 64 << 20) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each item's ``k`` best documents with a score above 0."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(docs["`" + id_col + "`"].cast("long").alias("doc_id"), docs["`" + text_col + "`"].cast("string").alias("text"))
    items = items.select(items["`" + item_col + "`"].cast("long").alias("item_id"), items["`" + item_text_col + "`"].cast("string").alias("text"))
    pairs = materialize(spark, items.mapInArrow(_distinct_terms, "item_id long, term binary").distinct(), "item_terms")
    total = pairs.agg(F.sum(F.octet_length("term") + 64)).first()[0]
    out_sql = "item_id long, rank int, doc_id long, score long"
    if not total:
        return spark.createDataFrame([], out_sql)
    blocks = -(-int(total) // block_bytes)
    pairs = pairs.withColumn("block", F.expr(f"pmod(xxhash64(7, item_id), {blocks})"))
    out = None
    for block in range(blocks):
        held = [(r.item_id, bytes(r.term)) for r in pairs.where(F.col("block") == block).select("item_id", "term").collect()]
        if not held:
            continue
        terms = tuple(sorted({t for _, t in held}))
        names = sorted({i for i, _ in held}, key=lambda i: (i is None, i or 0))
        number, item = {t: n for n, t in enumerate(terms)}, {i: n for n, i in enumerate(names)}
        postings: list[list[int]] = [[] for _ in terms]
        for i, t in held:
            postings[number[t]].append(item[i])
        counts = materialize(spark, docs.mapInArrow(_scan(terms), _COUNTS_SQL), "term_counts")
        n_docs, n_terms = counts.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            return spark.createDataFrame([], out_sql)
        weights = np.zeros(len(terms), np.int64)
        for t, df in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row per term of the block
            weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        scored = counts.where(F.size("terms") > 0)
        tops = scored.mapInArrow(_rank(weights, [np.array(sorted(p), np.int64) for p in postings], len(names), n_docs, n_terms, k), "item int, doc_id long, score long")
        tops = materialize(spark, tops.withColumn("task", F.spark_partition_id()), "task_tops")
        tasks = int(tops.agg(F.max("task")).first()[0] or 0) + 1
        tops = _top(tops.withColumn("group", F.col("task") % math.isqrt(tasks)), ["item", "group"], k, "_place")
        name = spark.createDataFrame(list(enumerate(names)), "item int, item_id long")
        part = _top(tops, ["item"], k).join(F.broadcast(name), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def lexical_search(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    return rank_documents(docs, items, **how)
