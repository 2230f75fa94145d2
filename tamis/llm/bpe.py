"""Byte-level BPE with vectorised pre-tokenisation (operator 4).

Method. A batch of texts becomes one array of code points. A table gives each code point a
class (letter, number, other, white space); numpy refines it by its neighbours (last white
space before other text, apostrophe that begins a contraction). Each class is a transition
function on nine states; composing functions is associative, so states come from a blocked
prefix scan: compose inside blocks of 64 characters for all blocks at once, scan the block
functions by doubling, then replay. A table of (state, class) marks where a piece begins. No
regular expression runs. The pieces are what ``public_tokenizers.PATTERN`` matches.

A piece's ids come from a bounded cache; a piece not in it is merged pair by pair, lowest
rank first (a heap for long pieces), as tiktoken does. The cache keeps the ids as bytes, so a
document's encoding is one join. Piece offsets are kept: decoding joins the ids' bytes, and
``piece_spans`` maps any id range back to the text.

Edge cases. Null is encoded like the empty text: no ids. Texts of any length are encoded
whole; batches are cut at about a million characters, a longer text is one batch. Repeated
rows are encoded each time. Special tokens' strings are ordinary text. Extra columns are
kept by ``encode_documents``; columns named like its result are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tamis.llm.encodings import read_ranks, vocabulary_path
from tamis.llm.frames import ship
from tamis.llm.words import slices

# Classes: letter, number, other, contraction of one or two letters, inner white space,
# last space and last other white space before text. Those of a text's first character
# come again, 8 higher.
L, N, O, C1, C2, W, P, Q = range(8)
# States: fresh, in letters, numbers, other or white space, after a leading space, one or two
# letters of a contraction to come, contraction complete.
FRESH, LET, NUM, OTH, WHITE, LEAD, ONE, TWO, DONE = range(9)
_S = 9
#: Code points with the property White_Space (fixed values of the Unicode standard).
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005,
               0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    go = np.zeros((16, _S), dtype=np.uint8)
    cut = np.ones((16, _S), dtype=bool)
    plain = {L: LET, N: NUM, O: OTH, C1: ONE, C2: TWO, W: WHITE, P: LEAD, Q: FRESH}
    for c, s in plain.items():
        go[c, :] = s
    go[L, ONE], go[L, TWO] = DONE, ONE
    for s in (LET, LEAD, ONE, TWO):
        cut[L, s] = False
    for s in (NUM, LEAD):
        cut[N, s] = False
    for c in (O, C1, C2):
        for s in (OTH, LEAD):
            cut[c, s], go[c, s] = False, OTH
    cut[W, WHITE] = False
    for c in range(8):
        go[c + 8, :] = go[c, FRESH]
    return go, cut


GO, CUT = _tables()


@functools.lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Letter, number or other of every code point; white space is W."""
    kinds = {"L": L, "N": N}
    t = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], O) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    t[list(WHITE_SPACE)] = W
    return t


def classes(cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Refined classes of code points; ``starts``: where each (non-empty) text begins."""
    c = class_table()[cp]
    n = len(c)
    first = np.zeros(n + 1, dtype=bool)
    first[starts] = True
    first[n] = True
    last = first[1:]  # the text's last character
    white = c == W
    ends = np.flatnonzero(white[:-1] & ~white[1:] & ~last[:-1])
    c[ends] = np.where(cp[ends] == 0x20, P, Q)
    q = np.flatnonzero(cp == 0x27)
    q = q[~last[q]]
    if len(q):
        a = cp[q + 1]
        c[q[np.isin(a, [ord(x) for x in "stmd"])]] = C1
        more = ~last[q + 1]
        q, a = q[more], a[more]
        b = cp[q + 2]
        two = np.zeros(len(q), dtype=bool)
        for x, y in ("re", "ve", "ll"):
            two |= (a == ord(x)) & (b == ord(y))
        c[q[two]] = C2
    c[starts] += 8
    return c


def boundaries(c: np.ndarray, block: int = 64) -> np.ndarray:
    """Where pieces begin, by a blocked scan of transition functions."""
    n = len(c)
    rows = -(-n // block)
    grid = np.zeros(rows * block, dtype=np.intp)
    grid[:n] = c
    grid = np.ascontiguousarray(grid.reshape(rows, block).T) * _S
    go, cut = GO.ravel(), CUT.ravel()
    f = np.broadcast_to(np.arange(_S, dtype=np.uint8), (rows, _S))
    for j in range(block):
        f = go[grid[j][:, None] + f]
    d = 1
    while d < rows:  # inclusive scan of the blocks' functions: later after earlier
        f = np.concatenate([f[:d], np.take_along_axis(f[d:], f[:-d].astype(np.intp), axis=1)])
        d *= 2
    state = np.full(rows, FRESH, dtype=np.uint8)
    state[1:] = f[:-1, FRESH]
    out = np.empty((block, rows), dtype=bool)
    for j in range(block):
        at = grid[j] + state
        out[j] = cut[at]
        state = go[at]
    return np.flatnonzero(out.T.ravel()[:n])


def piece_spans(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """(all texts joined, piece starts in it and its length at the end, index of each text's first piece)."""
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    joined = "".join(texts)
    at = np.concatenate([[0], np.cumsum(lens)])
    if not joined:
        return joined, np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    cuts = boundaries(classes(cp, at[:-1][lens > 0]))
    return joined, np.append(cuts, len(joined)), np.searchsorted(cuts, at)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: always the lowest-ranked adjacent pair first, leftmost among equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n <= 64:
        none, get = len(ranks), ranks.get
        parts = [piece[i:i + 1] for i in range(n)]
        pairs = [get(piece[i:i + 2], none) for i in range(n - 1)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]
    end = list(range(1, n + 1))      # end of the part that starts here; 0: no part starts here
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j = heapq.heappop(heap)
        m = end[i]
        if not m or m >= n or end[m] != j:
            continue
        end[i], end[m] = j, 0
        if j < n:
            before[j] = i
            if (r := ranks.get(piece[i:end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:j])) is not None:
            heapq.heappush(heap, (r, p, j))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class _Cache(dict):
    """Piece to its ids as little-endian 32-bit integers; kept per Python worker, of bounded size."""

    def __init__(self, ranks, most: int = 1_000_000, longest: int = 64):
        super().__init__()
        self.ranks, self.most, self.longest = ranks, most, longest

    def __missing__(self, piece: str) -> bytes:
        out = np.array(merge(piece.encode("utf-8"), self.ranks), dtype="<u4").tobytes()
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[piece] = out
        return out


@functools.lru_cache(maxsize=2)
def _cache(path: str) -> _Cache:
    return _Cache(read_ranks(path))


@functools.lru_cache(maxsize=2)
def _token_bytes(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for b, i in ranks.items():
        out[i] = b
    return out


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids, little-endian unsigned 32-bit."""
    joined, cuts, first = piece_spans(texts)
    cache = _cache(path)
    at = cuts.tolist()
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        p = at[a:b + 1]
        out.append(b"".join([cache[joined[x:y]] for x, y in zip(p, p[1:])]))
    return out


def decode_ids(ids: bytes, path: str) -> bytes:
    table = _token_bytes(path)
    return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def _mapper(text_at: int, path: str, digests: bool):
    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.schema.names[text_at], 1 << 20):
                texts = [t or "" for t in part.column(text_at).to_pylist()]
                ids = encode_texts(texts, path)
                rest = [part.column(i) for i in range(part.num_columns) if i != text_at or not digests]
                names = [n for i, n in enumerate(part.schema.names) if i != text_at or not digests]
                more = {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
                if digests:
                    more["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in ids])
                    more["decoded_sha256"] = pa.array([hashlib.sha256(decode_ids(x, path)).hexdigest() for x in ids])
                else:
                    more["ids"] = pa.array(ids, pa.binary())
                yield pa.RecordBatch.from_arrays([*rest, *more.values()], names=[*names, *more])
    return run


def encode_documents(docs: DataFrame, *, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with n_tokens and ids (little-endian unsigned 32-bit, as binary); one map-only pass."""
    ship(docs.sparkSession)
    docs = docs.drop("n_tokens", "ids")
    path = vocabulary or vocabulary_path("byte_bpe_multi_50k.tiktoken")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return docs.mapInArrow(_mapper(docs.columns.index(text_col), path, False), schema)


def decode_documents(encoded: DataFrame, *, vocabulary: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ``ids``."""
    ship(encoded.sparkSession)
    path = vocabulary or vocabulary_path("byte_bpe_multi_50k.tiktoken")

    @F.pandas_udf("binary")
    def decode(ids):
        return ids.map(lambda x: decode_ids(x, path), na_action="ignore")

    return encoded.withColumn("decoded", decode("ids"))


def bpe_round_trip(docs: DataFrame, *, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes decoded from them.

    Encodes and decodes in the same task, so that ids (more bytes than the text) stay there.
    """
    ship(docs.sparkSession)
    path = vocabulary or vocabulary_path("byte_bpe_multi_50k.tiktoken")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _mapper(1, path, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
