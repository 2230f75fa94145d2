"""Token ids in binary segments with one shared zstandard dictionary (operator 11).

Method. The ids of each document are serialized (unsigned 16-bit integers,
little-endian, if the vocabulary fits, else 32-bit) and compressed as one zstandard frame of their own
under a dictionary that all frames share. The frames, not the texts, are dealt into ranges of ascending doc_id (cut at
approximate quantiles of doc_id, one number per range), sorted there, and written as *segments*. A segment keeps, beside its frames, the dictionary's
sha256 and an offset index (byte offset and id offset of every document), so one short document is
read by decompressing its frame alone. Segments are rows of a Parquet table, which any store Spark
can write to holds; the index columns are read without the frames, and the doc_id bounds of a
segment are pushed down to the scan.

``<path>/dictionary`` has one row: sha256, bytes, ids per width. ``<path>/segments`` has one row
per segment: part, segment, first_doc_id, last_doc_id, before (ids of the part's earlier segments), n_ids,
dictionary_sha256, doc_ids, byte_offsets, id_offsets (both one longer than doc_ids), frames.

Dictionary. Trained on the serialized ids of at most ``sample_docs`` documents of 1 to ``sample_bytes``
bytes of text, those with the smallest hash (a documented bound: 2,000 documents of 4 KB). It changes
sizes only, never ids. Where the trainer finds too little to train on, the samples themselves are
the dictionary's content; without any sample the frames use none and the hash is that of no bytes.

Encoding. Class arrays over whole batches cut texts into the pieces of the vocabulary's pre-tokeniser (Latin-1 text;
chunks between white space that hold other characters, special tokens or odd controls go to the library
whole). Pieces are told apart by 64-bit hashes; the ``tokenizers`` library encodes each distinct one once per worker,
which keeps at most ``_KNOWN`` of them, as numbers.

Order and starts. The ids of all documents before a document are counted from one number per write
task (to the driver, and broadcast back), the segment's own count of earlier ids in its part, and the index.

Edge cases. A null text counts as empty: the end id only. Null doc_ids come last, and are written.
Rows that repeat a doc_id are written each, in a fixed but arbitrary order, over as many ranges as
their number asks for. Texts of any
length are one frame. An empty table gives an empty store. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import unicodedata

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tamis.llm.encodings import vocabulary_path
from tamis.llm.frames import scratch_path, ship
from tamis.llm.words import Words, hash_spans, slices, words

_KNOWN = 1_500_000
_LEVEL = 3

_SEGMENT = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("first_doc_id", pa.int64()), ("last_doc_id", pa.int64()),
                      ("before", pa.int64()), ("n_ids", pa.int64()), ("dictionary_sha256", pa.string()), ("doc_ids", pa.list_(pa.int64())),
                      ("byte_offsets", pa.list_(pa.int64())), ("id_offsets", pa.list_(pa.int64())), ("frames", pa.binary())])
_SEGMENT_SQL = ("part int, segment int, first_doc_id long, last_doc_id long, before long, n_ids long, dictionary_sha256 string, "
                "doc_ids array<long>, byte_offsets array<long>, id_offsets array<long>, frames binary")


#: Classes of Latin-1 characters, as the vocabulary's pre-tokeniser tells them apart.
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_CLASS = np.zeros(256, dtype=np.uint8)
for _c in map(chr, range(256)):
    _CLASS[ord(_c)] = _SPACE if _c in "\t\n\x0b\x0c\r \x85\xa0" else {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(_c)[0], _OTHER)
#: Letters that stay with an apostrophe before them (fixed values of the pre-tokeniser).
_ENDINGS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]


def cut_pieces(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, whole) of the pieces of all chunks between ASCII white space, by class arrays.

    A Latin-1 chunk is lower-cased and cut into runs of letters, single numbers, runs of anything
    else, and apostrophes with an ending. A chunk with other characters, a special token or a control that
    libraries class differently is one unit (``whole``), left for the library to cut.
    """
    data = np.concatenate([w.data, np.zeros(2, np.uint8)])
    n = len(w.data)
    lead2, lead3 = np.flatnonzero(data[:n] == 0xC2), np.flatnonzero(data[:n] == 0xC3)
    odd = (data >= 0xC4) | ((data >= 0x1C) & (data <= 0x1F))
    odd[lead2] |= data[lead2 + 1] == 0x85
    odd[:n] |= (data[:n] == 0x3C) & (data[1:n + 1] == 0x7C)
    upto = np.concatenate([[0], np.cumsum(odd)])
    whole = upto[w.end] > upto[w.start]

    kind = _CLASS[data]
    kind[lead2] = kind[lead2 + 1] = _CLASS[data[lead2 + 1]]
    kind[lead3] = kind[lead3 + 1] = _CLASS[np.minimum(data[lead3 + 1], 0xBF) + 0x40]
    low = data.copy()
    low[(data >= 0x41) & (data <= 0x5A)] += 32
    tail = data[lead3 + 1]
    low[lead3[(tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] + 1] += 32

    first = (data & 0xC0) != 0x80  # first byte of a character
    start = first & (kind != _SPACE)
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    start[w.start] = kind[w.start] != _SPACE
    quote = np.flatnonzero(start[:n] & (data[:n] == 0x27))
    last = w.end[np.searchsorted(w.start, quote, side="right") - 1]
    for ending in _ENDINGS:
        here = quote[(quote + len(ending) < last)]
        for i, c in enumerate(ending):
            here = here[low[here + 1 + i] == c]
        start[here + 1] = False
        after = here + 1 + len(ending)
        start[after] |= first[after] & (kind[after] != _SPACE)
    if whole.any():
        for at, till in zip(w.start[whole].tolist(), w.end[whole].tolist()):
            low[at:till] = data[at:till]
            start[at:till] = False
            start[at] = True
    begin = np.flatnonzero(start[:n])
    chunk = np.searchsorted(w.start, begin, side="right") - 1
    stop = np.flatnonzero((kind[:n] == _SPACE) & first[:n])
    cuts = np.concatenate([begin, stop, [n]])
    cuts.sort(kind="stable")
    end = np.minimum(cuts[np.searchsorted(cuts, begin, side="right")], w.end[chunk])
    end = np.where(whole[chunk], w.end[chunk], end)
    return low, begin, end, whole[chunk]


class Encoder:
    """Token ids of texts by the library; every distinct piece is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._forget()

    def _forget(self) -> None:
        """No piece is known: sorted hashes, and where the ids of each begin in ``flat`` and how many they are."""
        self.keys, self.begin, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def _alone(self, strings: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch(strings, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings that are one piece each, and the number of each: many are encoded as one text and told apart by the library's piece numbers."""
        groups = [pieces[i:i + 200] for i in range(0, len(pieces), 200)]
        ids, held = [], []
        for g, e in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            word = np.array(e.word_ids, dtype=np.int64)
            n = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1, [len(word)]]))
            if len(n) == len(g):
                ids.append(np.array(e.ids, dtype=self.dtype))
                held.append(n)
            else:
                each = self._alone(g)
                ids += each
                held.append(np.array([len(x) for x in each]))
        return np.concatenate(ids), np.concatenate(held)

    def _learn(self, keys: np.ndarray, strings: list[str], whole: np.ndarray) -> None:
        order = np.argsort(whole, kind="stable")
        plain = len(whole) - int(whole.sum())
        ids, held = self._pieces([strings[i] for i in order[:plain]]) if plain else (self.flat[:0], self.size[:0])
        each = self._alone([strings[i] for i in order[plain:]]) if plain < len(order) else []
        held = np.concatenate([held, np.array([len(x) for x in each], dtype=np.int64)])
        begin = len(self.flat) + np.cumsum(held) - held
        self.flat = np.concatenate([self.flat, ids, *each])
        keys = np.concatenate([self.keys, keys[order]])
        order = np.argsort(keys, kind="stable")
        self.keys, self.begin, self.size = keys[order], np.concatenate([self.begin, begin])[order], np.concatenate([self.size, held])[order]

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, row bounds in them) of an Arrow string column; null counts as empty."""
        w = words(texts)
        if not len(w.start):
            return np.zeros(0, self.dtype), np.zeros(len(w.offsets), np.int64)
        data, start, end, whole = cut_pieces(w)
        distinct, first, which = np.unique(hash_spans(data, start, end), return_index=True, return_inverse=True)
        if len(self.keys) > _KNOWN or len(self.flat) > 16 * _KNOWN:
            self._forget()
        at = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != distinct[inside]
        if new.any():
            f = first[new]
            self._learn(distinct[new], [data[a:b].tobytes().decode() for a, b in zip(start[f].tolist(), end[f].tolist())], whole[f])
            at = np.searchsorted(self.keys, distinct)
        at = at[which]
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(ends[-1]) + np.repeat(self.begin[at] - ends[:-1], size)
        return self.flat[place], ends[np.searchsorted(start, w.offsets)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary for ``samples``; their own bytes where there is too little to train on."""
    samples = [s for s in samples if s]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


def sha256(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def _range_of(doc: pa.Array, g: np.ndarray, bounds: np.ndarray, null_ranges: int) -> np.ndarray:
    """The range each row is dealt to, in ascending order of (doc_id, g), null ids after all others.

    A doc_id that is a bound, once or more, may lie in any range beside it: its rows are dealt to those by ``g``.
    """
    null = doc.is_null().to_numpy(zero_copy_only=False)
    ids = doc.fill_null(0).to_numpy()
    low = np.where(null, len(bounds) + 1, np.searchsorted(bounds, ids, side="left"))
    high = np.where(null, len(bounds) + max(1, null_ranges), np.searchsorted(bounds, ids, side="right"))
    share = g.astype(np.float64) / 2.0 ** 64 + 0.5
    return low + np.minimum((share * (high - low + 1)).astype(np.int64), high - low)


def _encoder(path: str, raw: bytes, end_id: int, bounds: np.ndarray, null_ranges: int):
    """Each document's frame, its number of ids and its range."""
    def run(batches):
        enc = encoder(path)
        end, width = np.array([end_id], dtype=enc.dtype).tobytes(), enc.dtype.itemsize
        squeeze = zstandard.ZstdCompressor(level=_LEVEL, dict_data=_dictionary(raw))
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                flat, at = enc.encode(b.column("text"))
                at = at.tolist()
                frames = [squeeze.compress(flat[i:j].tobytes() + end) for i, j in zip(at, at[1:])]
                n = np.diff(at) + len(end) // width
                place = _range_of(b.column("doc_id"), b.column("g").to_numpy(), bounds, null_ranges)
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), b.column("doc_id"), b.column("g"), pa.array(n, pa.int64()), pa.array(frames, pa.binary())],
                                                 names=["place", "doc_id", "g", "n", "frame"])
    return run


def _gather(digest: str, segment_bytes: int):
    """Segments of the sorted frames of a range."""
    def run(batches):
        part, number, before = TaskContext.get().partitionId(), 0, 0
        ids, at, count, frames = [], [0], [0], []

        def segment():
            row = [part, number, next((i for i in ids if i is not None), None), next((i for i in reversed(ids) if i is not None), None),
                   before, count[-1], digest, ids, at, count, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _SEGMENT.types)], schema=_SEGMENT)

        for b in batches:
            for d, n, frame in zip(*[c.to_pylist() for c in b.columns]):
                frames.append(frame)
                ids.append(d)
                at.append(at[-1] + len(frame))
                count.append(count[-1] + n)
                if at[-1] >= segment_bytes:
                    yield segment()
                    number, before = number + 1, before + count[-1]
                    ids, at, count, frames = [], [0], [0], []
        if ids:
            yield segment()
    return run


def write_token_store(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
                      vocabulary: str | None = None, dictionary_bytes: int = 65_536, sample_docs: int = 2000,
                      sample_bytes: int = 4096, segment_bytes: int = 4 << 20) -> None:
    """Writes the documents' token ids under ``path`` (dictionary and segments), in ascending order of ids."""
    spark = docs.sparkSession
    ship(spark)
    vocabulary = vocabulary or vocabulary_path("word_bpe_49k.json")
    rows = docs.select(docs["`" + id_col + "`"].cast("long").alias("doc_id"), docs["`" + text_col + "`"].cast("string").alias("text"))
    ranges = max(1, rows.rdd.getNumPartitions())
    short = F.octet_length("text").between(1, sample_bytes)
    cuts = F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], max(10_000, 20 * ranges))
    n, n_named, n_short, bounds = rows.agg(F.count(F.lit(1)), F.count("doc_id"), F.count_if(short), cuts).first()
    null_ranges = -(-ranges * (n - n_named) // max(1, n))
    bounds = np.array(bounds or [], dtype=np.int64)
    # a few more than asked for by hash, so that tasks send little, then the smallest hashes
    most = -(1 << 63) + min(1 << 64, int((1 << 64) * 2 * (sample_docs + 50) / max(1, n_short))) - 1
    drawn = rows.withColumn("h", F.xxhash64("text", "doc_id")).where(short & (F.col("h") <= most))
    sample = [r.text for r in drawn.orderBy("h", "text").limit(sample_docs).select("text").collect()]
    enc = Encoder(vocabulary)
    flat, at = enc.encode(pa.array(sample, pa.string()))
    raw = train_dictionary([flat[i:j].tobytes() for i, j in zip(at.tolist(), at.tolist()[1:])], dictionary_bytes)
    (spark.createDataFrame([(sha256(raw), raw, enc.dtype.itemsize)], "sha256 string, dictionary binary, id_bytes int")
     .coalesce(1).write.parquet(f"{path}/dictionary"))
    keyed = rows.withColumn("g", F.xxhash64("text", F.monotonically_increasing_id()))
    framed = keyed.mapInArrow(_encoder(vocabulary, raw, end_id, bounds, null_ranges), "place int, doc_id long, g long, n long, frame binary")
    dealt = framed.repartitionById(len(bounds) + 1 + null_ranges, "place").sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "g")
    dealt.select("doc_id", "n", "frame").mapInArrow(_gather(sha256(raw), segment_bytes), _SEGMENT_SQL).write.parquet(f"{path}/segments")


def read_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes, str]:
    """(sha256, dictionary, numpy type of the serialized ids) of a store; checks the hash."""
    digest, raw, width = spark.read.parquet(f"{path}/dictionary").select("sha256", "dictionary", "id_bytes").first()
    raw = bytes(raw)
    if sha256(raw) != digest:
        raise ValueError(f"the dictionary of {path} is not the one its hash names")
    return digest, raw, f"<u{width}"


_DOC = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _reader(digest: str, raw: bytes, dtype: str, only: bool):
    """Documents of segments with their ids as little-endian u32; ``only`` those at the positions asked for."""
    def run(batches):
        expand = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        for b in batches:
            names = b.schema.names
            col = lambda c: b.column(names.index(c))
            for r in range(b.num_rows):
                if col("dictionary_sha256")[r].as_py() != digest:
                    raise ValueError("a segment was written with another dictionary")
                ids, first = col("doc_ids")[r].as_py(), col("start")[r].as_py()
                at, count = col("byte_offsets")[r].as_py(), col("id_offsets")[r].as_py()
                frames = memoryview(col("frames")[r].as_buffer())
                wanted = col("positions")[r].as_py() if only else range(len(ids))
                out, held = ([], [], [], []), 0
                for i in wanted:
                    tokens = np.frombuffer(expand.decompress(frames[at[i]:at[i + 1]]), dtype=dtype).astype("<u4").tobytes()
                    for c, v in zip(out, (ids[i], first + count[i], count[i + 1] - count[i], tokens)):
                        c.append(v)
                    held += len(tokens)
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _DOC.types)], schema=_DOC)
                        out, held = ([], [], [], []), 0
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _DOC.types)], schema=_DOC)
    return run


_DOC_SQL = "doc_id long, start long, n_tokens long, ids binary"


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``: the ids of all segments before each. One number per write task reaches the driver."""
    seg = spark.read.parquet(f"{path}/segments")
    totals = sorted((p, n) for p, n in seg.groupBy("part").agg(F.sum("n_ids")).collect())
    starts = itertools.accumulate((n for _, n in totals), initial=0)
    starts = spark.createDataFrame([(p, s) for (p, _), s in zip(totals, starts)], "part int, part_start long")
    return seg.join(F.broadcast(starts), "part").withColumn("start", F.col("part_start") + F.col("before"))


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian u32) of every document."""
    ship(spark)
    digest, raw, dtype = read_dictionary(spark, path)
    return segment_starts(spark, path).mapInArrow(_reader(digest, raw, dtype, False), _DOC_SQL)


def fetch_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The documents with the given ids (at most 1,000), reading their segments and expanding their frames only."""
    if len(ids) > 1000:
        raise ValueError("at most 1,000 ids; join read_token_store for more")
    ship(spark)
    digest, raw, dtype = read_dictionary(spark, path)
    want = F.array(*[F.lit(int(i)) for i in ids]).cast("array<bigint>")
    seg = segment_starts(spark, path)
    if ids:
        seg = seg.where((F.col("first_doc_id") <= max(ids)) & (F.col("last_doc_id") >= min(ids)))
    at = F.filter(F.sequence(F.lit(0), F.size("doc_ids") - 1), lambda i: F.coalesce(F.array_contains(want, F.get("doc_ids", i)), F.lit(False)))
    seg = seg.withColumn("positions", at).where(F.size("positions") > 0)
    return seg.mapInArrow(_reader(digest, raw, dtype, True), _DOC_SQL)


def token_store(docs: DataFrame, **how) -> DataFrame:
    """Writes the store to the shared folder and reads it back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_token_store(docs, path, **how)
    return read_token_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
