"""Toxicity scores from a counterfactually regularised linear classifier (operator 1).

Method. A logistic model over the words of a text (and the first four bytes of longer
words, so that inflected forms share evidence). Next to the label loss, training takes
every sentence of a labelled document that names a group ("women", "muslims", ...),
swaps the term for each of its counterparts, and adds ``swap_weight`` times the squared
difference of the two scores. A term therefore cannot carry a score of its own: a
neutral mention of a group stays neutral although the term occurs in toxic documents.

Fitting uses a bounded, documented sample: at most ``max_train`` labelled rows (those
with the smallest seeded hash of doc_id, one text each: the least where rows repeat a doc_id) and, apart from
those, at most ``max_swaps`` swapped sentences.
Their sparse features are the only thing the driver collects. Scoring runs over every
row and whole text, map-only, with the fitted weights (a few thousand numbers) in the
task. labels, lang, source and doc_id are never features.

Edge cases. Null and empty texts have no feature and score as the model's bias. No
labelled row at all, or only one class: every score is the (smoothed) share of toxic
labels. A doc_id that is labelled several times counts once, as toxic if any label says
so. Null labels, or labels other than 0 and 1, are not used. Repeated rows of
``documents`` are scored each on its own. Extra columns are kept by ``score_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tamis.llm.frames import materialize, pick, ship
from tamis.llm.words import ALNUM, Words, hash_spans, slices, word_hashes, words

#: Terms that name a group; each line holds counterparts of one another.
IDENTITY_GROUPS = (
    "women men", "woman man", "girls boys", "female male", "mothers fathers",
    "muslims christians jews hindus buddhists atheists", "muslim christian jewish hindu buddhist atheist",
    "black white asian latino arab", "gay straight lesbian bisexual transgender",
    "immigrants natives", "refugees citizens", "disabled deaf blind", "elderly young",
    "american mexican chinese indian german french spanish african",
    "frauen männer", "frau mann", "muslime christen juden", "ausländer einheimische",
    "femmes hommes", "femme homme", "musulmans chrétiens juifs", "immigrés citoyens",
    "mujeres hombres", "mujer hombre", "musulmanes cristianos judíos", "inmigrantes ciudadanos",
)

_PREFIX = 4
_SENTENCE_END = np.zeros(256, dtype=bool)
_SENTENCE_END[[ord(c) for c in ".!?\n"]] = True


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, 32-bit feature) pairs, each pair once: words and the prefixes of longer words."""
    h = word_hashes(w)
    long = np.flatnonzero(w.end - w.start > _PREFIX)
    p = hash_spans(w.data, w.start[long], w.start[long] + _PREFIX, seed=1)
    f = np.concatenate([h, p]) >> np.uint64(32)
    r = np.concatenate([w.row, w.row[long]]).astype(np.uint64)
    both = np.unique((r << np.uint64(32)) | f)
    return (both >> np.uint64(32)).astype(np.int64), both.astype(np.uint32)


def _one(text: str) -> np.ndarray:
    return features(words(pa.array([text]), ALNUM, lower=True))[1]


def _term_hash(term: str) -> int:
    w = words(pa.array([term]), ALNUM, lower=True)
    return int(word_hashes(w)[0])


@dataclass
class ToxicityModel:
    feature: np.ndarray   # sorted uint32
    weight: np.ndarray
    bias: float
    info: dict = field(default_factory=dict)

    def scores(self, column) -> np.ndarray:
        w = words(column, ALNUM, lower=True)
        n = len(w.offsets) - 1
        z = np.full(n, self.bias)
        if len(self.feature) and len(w.start):
            row, f = features(w)
            at = np.minimum(np.searchsorted(self.feature, f), len(self.feature) - 1)
            hit = self.feature[at] == f
            z += np.bincount(row[hit], weights=self.weight[at[hit]], minlength=n)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def _blob(f: np.ndarray) -> bytes:
    return np.sort(f.astype("<u4")).tobytes()


def _training_rows(groups: tuple[str, ...]):
    """Arrow mapper: a row per document (kind 0), and one per swapped sentence (kind 1)."""

    def run(batches):
        family = {}
        for line in groups:
            terms = line.split()
            for t in terms:
                family[_term_hash(t)] = (t, [x for x in terms if x != t])
        known = np.array(sorted(family), dtype=np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"), ALNUM, lower=True)
                row, f = features(w)
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                order, toxic = part.column("_order").to_pylist(), part.column("_toxic").to_pylist()
                out = [(0, order[i], toxic[i], _blob(f[cut[i]:cut[i + 1]]), None) for i in range(part.num_rows)]
                h = word_hashes(w)
                named = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h) if len(known) else []
                for k in named:
                    a, b = int(w.offsets[w.row[k]]), int(w.offsets[w.row[k] + 1])
                    text = w.data[a:b]
                    ends = np.flatnonzero(_SENTENCE_END[text]) + a
                    j = int(np.searchsorted(ends, w.start[k]))
                    lo = int(ends[j - 1]) + 1 if j else a
                    hi = int(ends[j]) if j < len(ends) else b
                    term, others = family[int(h[k])]
                    left, right = w.data[lo:w.start[k]].tobytes(), w.data[w.end[k]:hi].tobytes()
                    was = _one((left + term.encode() + right).decode("utf-8", "replace"))
                    for other in others:
                        now = _one((left + other.encode() + right).decode("utf-8", "replace"))
                        out.append((1, order[w.row[k]], None, _blob(was), _blob(now)))
                kinds, orders, toxics, a, b = zip(*out) if out else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds, pa.int32()), pa.array(orders, pa.int64()), pa.array(toxics, pa.int32()),
                     pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["kind", "ord", "toxic", "a", "b"])

    return run


def _csr(blobs: list[bytes], vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the blobs' features that are in vocab."""
    rows = np.repeat(np.arange(len(blobs)), [len(b) // 4 for b in blobs])
    f = np.frombuffer(b"".join(blobs), dtype="<u4")
    if not len(vocab):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocab, f), len(vocab) - 1)
    hit = vocab[at] == f
    return rows[hit], at[hit]


def fit_features(docs: list[bytes], y: np.ndarray, swaps: list[tuple[bytes, bytes]], *, swap_weight: float,
                 l2: float, min_z: float, steps: int) -> ToxicityModel:
    """The model from sparse features: screening by a two-proportion z-score, then full-batch Adam."""
    n, n1 = len(y), int(y.sum())
    n0 = n - n1
    if not n or not n1 or not n0:
        share = (n1 + 0.5) / (n + 1.0) if n else 0.05
        return ToxicityModel(np.zeros(0, np.uint32), np.zeros(0), float(np.log(share / (1 - share))), {"rows": n})
    sizes = [len(b) // 4 for b in docs]
    f = np.frombuffer(b"".join(docs), dtype="<u4")
    seen, where = np.unique(f, return_inverse=True)
    pos = np.bincount(where, weights=np.repeat(y, sizes), minlength=len(seen))
    all_ = np.bincount(where, minlength=len(seen))
    p = all_ / n
    z = (pos / n1 - (all_ - pos) / n0) / np.sqrt(np.maximum(p * (1 - p) * (1 / n1 + 1 / n0), 1e-12))
    keep = (np.abs(z) >= min_z) & (all_ >= 2)
    swapped = np.unique(np.frombuffer(b"".join(a + b for a, b in swaps), dtype="<u4")) if swaps else np.zeros(0, "<u4")
    vocab = np.union1d(seen[keep], np.intersect1d(swapped, seen)).astype(np.uint32)
    m = len(vocab)
    r, c = _csr(docs, vocab)
    ra, ca = _csr([a for a, _ in swaps], vocab)
    rb, cb = _csr([b for _, b in swaps], vocab)
    k = len(swaps)
    w, bias = np.zeros(m), float(np.log(n1 / n0))
    mw, vw, mb, vb = np.zeros(m), np.zeros(m), 0.0, 0.0
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -35, 35)))
    for t in range(1, steps + 1):
        q = sig(bias + np.bincount(r, weights=w[c], minlength=n))
        d = (q - y) / n
        g = np.bincount(c, weights=d[r], minlength=m) + l2 * w / n
        gb = d.sum()
        if k:
            sa = sig(bias + np.bincount(ra, weights=w[ca], minlength=k))
            sb = sig(bias + np.bincount(rb, weights=w[cb], minlength=k))
            da = 2 * swap_weight * (sa - sb) / k
            ga, gc = da * sa * (1 - sa), -da * sb * (1 - sb)
            g += np.bincount(ca, weights=ga[ra], minlength=m) + np.bincount(cb, weights=gc[rb], minlength=m)
            gb += (ga + gc).sum()
        rate = 0.3 / (1 + 2.0 * t / steps)
        mw, vw = 0.9 * mw + 0.1 * g, 0.99 * vw + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w = w - rate * (mw / (1 - 0.9 ** t)) / (np.sqrt(vw / (1 - 0.99 ** t)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9 ** t)) / (np.sqrt(vb / (1 - 0.99 ** t)) + 1e-8)
    return ToxicityModel(vocab, w, float(bias), {"rows": n, "toxic": n1, "features": m, "swaps": k})


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 label_id: str = "doc_id", label_col: str = "toxic", train_on=None, max_train: int = 16_000,
                 max_swaps: int = 20_000, groups: tuple[str, ...] = IDENTITY_GROUPS, swap_weight: float = 4.0,
                 l2: float = 0.5, min_z: float = 5.0, steps: int = 150, seed: int = 17) -> ToxicityModel:
    """Fit on a bounded sample of the labelled rows; ``train_on(id column)`` picks the rows that may be used."""
    ship(docs.sparkSession)
    lab = pick(labels, _id=label_id, _toxic=label_col).where(F.col("_toxic").isin(0, 1) & F.col("_id").isNotNull())
    if train_on is not None:
        lab = lab.where(train_on(F.col("_id")))
    order = F.xxhash64(F.lit(seed), F.col("_id"))
    lab = (lab.groupBy("_id").agg(F.max("_toxic").cast("int").alias("_toxic")).withColumn("_order", order)
           .orderBy("_order", "_id").limit(max_train))  # bounded: at most max_train short rows
    texts = pick(docs, _id=id_col, text=text_col).join(F.broadcast(lab), "_id")
    texts = texts.groupBy("_id", "_order", "_toxic").agg(F.min(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))  # one text per labelled id
    rows = texts.select("_order", "_toxic", "text").mapInArrow(_training_rows(groups), "kind int, ord long, toxic int, a binary, b binary")
    rows = materialize(docs.sparkSession, rows, "training")
    got = rows.where("kind = 0").orderBy("ord", "a").limit(max_train).select("toxic", "a").toArrow()
    swapped = rows.where("kind = 1").orderBy("ord", "a", "b").limit(max_swaps).select("a", "b").toArrow()
    a, y = got.column("a").to_pylist(), got.column("toxic").to_pylist()
    swaps = list(zip(swapped.column("a").to_pylist(), swapped.column("b").to_pylist()))
    return fit_features(a, np.array(y, dtype=float), swaps, swap_weight=swap_weight,
                        l2=l2, min_z=min_z, steps=steps)


def score_documents(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score in [0, 1] for every row, whole text, one map-only pass.

    A column of that name in ``docs`` is replaced.
    """
    ship(docs.sparkSession)
    feature, weight, bias = model.feature, model.weight, model.bias

    @F.pandas_udf("double")
    def score(texts):
        m = ToxicityModel(feature, weight, bias)
        t = pa.table({"text": pa.array(texts, pa.string(), from_pandas=True)})
        import pandas as pd
        return pd.Series(np.concatenate([m.scores(p.column("text")) for p in slices(t, "text")] or [np.zeros(0)]))

    return docs.withColumn(score_col, score(F.col("`" + text_col.replace("`", "``") + "`").cast("string")))


def held_out(doc_id):
    """The rows no model may learn from: crc32 of the id's decimal text, mod 4, is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learns from the rows not held out only."""
    model = fit_toxicity(docs, labels, train_on=lambda i: ~held_out(i), **fit)
    rows = score_documents(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))
