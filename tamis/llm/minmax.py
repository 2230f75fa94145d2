"""MinHash near-duplicates with min-max hashing (operator 8).

Method. A document's set is its distinct word shingles (five words, A-Z lower-cased; fewer
words: the whole sequence). Under each permutation both the minimum and the maximum of the
set are kept: each agrees between two documents with the probability of their Jaccard
similarity, so 64 permutations give a signature of 128 values. Four values of four
permutations make a band (bands of minima and bands of maxima); at a similarity of 0.75 two
documents share none of the 32 bands with probability 5e-6.

1. The texts are written once, bucketed by blocks of bounded rows and bytes. One map-only pass gives each
   document its set size, a 128-bit digest of the whole set, the 32 band keys and a byte of
   each signature value. Documents with equal sets are one class from here on (their links
   are certain), so copies cost nothing further.
2. Star candidates: in every band bucket, each class against the bucket's first class. The
   signature bytes drop pairs far from the threshold (six standard deviations), the rest is
   confirmed on the full sets, recomputed from the texts of those documents only.
3. Components of the confirmed links. Buckets that still hold two or more components are
   cut into blocks of about 512 classes, those of the largest component apart from the rest.
   Every pair of blocks is one group, but for pairs inside the largest component, so a bucket
   with one great component and few other classes costs a number of rows linear in it. A group
   looks at pairs of different components, each pair in the first band only that joins it,
   and asks for the texts of the classes with a pair the signatures do not exclude. With the
   texts it confirms such pairs on full sets, skips those it has already joined, and so
   returns at most one link per class. No group emits its pairs.

Texts reach the groups that need them through the block table, so texts nobody needs are
not shuffled.

Edge cases. Null, empty and blank texts have no set, are linked with nothing and are their
own component. Rows that repeat a doc_id are one document of several texts: they share a
component. A row with a null doc_id links like any other; its component_id is the smallest
doc_id reachable, null if there is none (it is then kept). An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tamis.llm.components import connected_components
from tamis.llm.frames import materialize, ship, write_blocks
from tamis.llm.words import grams, mix, slices, word_hashes, words

PERMUTATIONS = 64
ROWS = 4  # values in a band
_BANDS = 2 * PERMUTATIONS // ROWS
_BLOCK = 512
_BLOCK_BYTES = 4 << 20  # of text in one block of the texts


def shingle_sets(column, size: int = 5) -> list[np.ndarray]:
    """Each row's set as sorted distinct 64-bit hashes of its shingles."""
    w = words(column, lower=True)
    h = word_hashes(w)
    g = grams(h, size)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(g[a:b - size + 1]))
        elif b > a:
            out.append(mix(grams(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n] | np.uint64(1), x[n:]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(rows, 2 x PERMUTATIONS): minima, then maxima, as 32-bit values. Sets must not be empty."""
    a, b = _multipliers(PERMUTATIONS)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    out = np.empty((len(sets), 2 * PERMUTATIONS), dtype=np.uint32)
    x = np.concatenate(sets)
    x ^= x >> np.uint64(32)
    for i in range(PERMUTATIONS):
        y = (x ^ b[i]) * a[i]
        out[:, i] = np.minimum.reduceat(y, at) >> np.uint64(32)
        out[:, PERMUTATIONS + i] = np.maximum.reduceat(y, at) >> np.uint64(32)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, bands) 64-bit keys; the band's number is part of the key."""
    v = sig.reshape(len(sig), _BANDS, ROWS).astype(np.uint64)
    k = np.arange(1, _BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        k = mix(k ^ (v[:, :, j] + np.uint64(j)) * np.uint64(0xD6E8FEB86659FD93))
    return k.view(np.int64)


def _sketch(size: int):
    fields = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()),
                        ("keys", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), size)
                n = [len(s) for s in sets]
                full = [i for i, k in enumerate(n) if k]
                keys, sig, digest = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if full:
                    s = signatures([sets[i] for i in full])
                    k = band_keys(s).tolist()
                    small = (s & 255).astype(np.uint8)
                    for j, i in enumerate(full):
                        keys[i], sig[i] = k[j], small[j].tobytes()
                        digest[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays([part.column("block"), part.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                                                  pa.array(keys, fields.field("keys").type), pa.array(sig, pa.binary())], schema=fields)
    return run


_SKETCH = "block long, doc_id long, n_shingles long, digest binary, keys array<long>, sig binary"


def _near(n_a, n_b, threshold: float):
    """Sizes that a similarity of the threshold allows."""
    return (F.least(n_a, n_b) >= threshold * F.greatest(n_a, n_b))


def estimate_floor(threshold: float) -> float:
    """The signature agreement below which a pair at the threshold is, six standard deviations off, out of reach."""
    return max(0.0, threshold - 6.5 * (threshold * (1 - threshold) / (2 * PERMUTATIONS)) ** 0.5)


def _agreement(pairs: DataFrame, floor: float) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) whose signature bytes agree often enough."""
    @F.pandas_udf("boolean")
    def agree(x, y):
        import pandas as pd
        if not len(x):
            return pd.Series([], dtype=bool)
        u = np.frombuffer(b"".join(x), dtype=np.uint8).reshape(len(x), -1)
        v = np.frombuffer(b"".join(y), dtype=np.uint8).reshape(len(y), -1)
        return pd.Series((u == v).mean(axis=1) >= floor)
    return pairs.where(agree("sig_a", "sig_b")).select("a", "b")


def _confirm(size: int, percent: int):
    fields = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("percent", pa.int32())])

    def run(key, t):
        center = key[0].as_py()
        sets = dict(zip(t.column("doc_id").to_pylist(), shingle_sets(t.column("text"), size)))
        mine, out = sets[center], []
        for b, s in sets.items():
            if b != center:
                both = len(np.intersect1d(mine, s, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(s) - both):
                    out.append((center, b))
        x, y = zip(*out) if out else ((), ())
        return pa.Table.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array([percent] * len(x), pa.int32())], schema=fields)
    return run


_GROUP = ["key", "lo", "hi"]


def _hand_out(key, need, texts):
    """The texts of one block that groups ask for."""
    where = {d: i for i, d in enumerate(texts.column("doc_id").to_pylist())}
    at = pa.array([where[d] for d in need.column("doc_id").to_pylist()], pa.int64())
    return need.drop_columns(["block"]).append_column("text", texts.column("text").take(at))


def _with_texts(need: DataFrame, blocks: DataFrame) -> DataFrame:
    """``need`` (key, lo, hi, block, doc_id, component) with each document's text, one row per group and document."""
    need = need.select(*_GROUP, "block", "doc_id", "component")
    return need.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(
        _hand_out, "key long, lo int, hi int, doc_id long, component long, text string")


def _stars(pairs: DataFrame, lone: DataFrame, blocks: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; at most some 64 partners of a document in one group."""
    n = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    salted = pairs.join(n, "a").select("a", "b", F.expr("cast(pmod(xxhash64(b), cast(ceil(_n / 64) as long)) as int)").alias("lo"))
    salted = materialize(pairs.sparkSession, salted, "pairs")
    need = salted.select(F.col("a").alias("key"), "lo", F.col("b").alias("doc_id")).union(salted.select(F.col("a").alias("key"), "lo", F.col("a").alias("doc_id")).distinct())
    need = need.withColumn("hi", F.col("lo")).withColumn("component", F.lit(None).cast("long")).join(lone.select("doc_id", "block"), "doc_id")
    return _with_texts(need, blocks).groupBy(*_GROUP).applyInArrow(_confirm(size, percent), "a long, b long, percent int").select("a", "b")


class _Pairs:
    """Candidate pairs in one pair of blocks of a bucket."""

    def __init__(self, key: int, ids, comp, n, sig, keys, left, right, threshold: float, floor: float):
        self.band = np.argmax(keys == key, axis=1)
        self.key, self.ids, self.comp, self.n, self.sig, self.keys = key, ids, comp, n, sig, keys
        self.left, self.right, self.same = left, right, len(left) == len(right) and bool((left == right).all())
        self.threshold, self.floor = threshold, floor

    def of(self, i: int) -> np.ndarray:
        """The partners of row i: another component, a size that may do, no earlier band in common, signatures near."""
        r = self.right
        if self.same:
            r = r[r > i]
        r = r[(self.comp[r] != self.comp[i]) & (np.minimum(self.n[r], self.n[i]) >= self.threshold * np.maximum(self.n[r], self.n[i]))]
        r = r[(self.sig[r] == self.sig[i]).mean(axis=1) >= self.floor]
        if len(r):
            r = r[np.argmax(self.keys[r] == self.keys[i], axis=1) == self.band[i]]
        return r


def _ask(threshold: float, floor: float):
    """The classes of a group that have a candidate pair."""
    fields = pa.schema([("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("doc_id", pa.int64())])

    def run(key, t):
        lo, hi = key[1].as_py(), key[2].as_py()
        block, ids = t.column("part").to_numpy(), t.column("doc_id").to_numpy()
        keys = np.stack(t.column("keys").to_pylist()).astype(np.int64)
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        p = _Pairs(key[0].as_py(), ids, t.column("component").to_numpy(), t.column("n_shingles").to_numpy(), sig, keys, left, right, threshold, floor)
        need = np.zeros(len(ids), dtype=bool)
        for i in left.tolist():
            r = p.of(i)
            if len(r):
                need[r] = need[i] = True
        got = ids[need]
        return pa.Table.from_arrays([pa.array(np.full(len(got), key[0].as_py()), pa.int64()), pa.array([lo] * len(got), pa.int32()),
                                     pa.array([hi] * len(got), pa.int32()), pa.array(got, pa.int64())], schema=fields)
    return run


def _join_components(size: int, percent: int, threshold: float, floor: float):
    """Links that join components inside one group, confirmed on full sets: at most one per class."""
    fields = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(key, t):
        sets = shingle_sets(t.column("text"), size)
        ids, comp = t.column("doc_id").to_numpy(), t.column("component").to_numpy().copy()
        n = np.array([len(s) for s in sets])
        full = signatures(sets)
        every = np.arange(len(ids))
        p = _Pairs(key[0].as_py(), ids, comp, n, (full & 255).astype(np.uint8), band_keys(full), every, every, threshold, floor)
        code = np.unique(np.concatenate(sets), return_inverse=True)[1]
        end = np.cumsum(n)
        mark = np.zeros(int(code.max()) + 1, dtype=np.int64)
        out = []
        for i in every.tolist():
            r = p.of(i)
            if not len(r):
                continue
            mine = code[end[i] - n[i]:end[i]]
            mark[mine] = 1
            for j in r.tolist():
                if comp[j] == comp[i]:
                    continue
                both = int(mark[code[end[j] - n[j]:end[j]]].sum())
                if 100 * both >= percent * (n[i] + n[j] - both):
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                    comp[comp == comp[j]] = comp[i]
            mark[mine] = 0
        x, y = zip(*out) if out else ((), ())
        return pa.Table.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], schema=fields)
    return run


def _components(texts: DataFrame, sure: DataFrame | None, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles) of every row and (doc_id, component) of every non-empty set.

    ``texts`` has unique ids; ``sure``: pairs (a, b) linked in any case.
    """
    spark = texts.sparkSession
    threshold = percent / 100
    floor = estimate_floor(threshold)
    blocks = write_blocks(texts, "text", 2048, _BLOCK_BYTES).select("block", "doc_id", "text")
    sketch = materialize(spark, blocks.mapInArrow(_sketch(size), _SKETCH), "sketches")
    real = sketch.where("doc_id is not null and n_shingles > 0")
    classes = real.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("class"))
    member = materialize(spark, real.select("doc_id", "digest", "n_shingles").join(classes, ["digest", "n_shingles"]), "members")
    lone = materialize(spark, sketch.join(member.where("doc_id = class").select("doc_id"), "doc_id", "left_semi"), "representatives")
    key = lone.select(F.explode("keys").alias("key"), "doc_id")
    buckets = materialize(spark, key.groupBy("key").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    in_bucket = materialize(spark, key.join(buckets, "key"), "bucketed")

    side = lambda x: lone.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    stars = in_bucket.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    stars = stars.join(side("b"), "b").join(side("a"), "a").where(_near(F.col("n_a"), F.col("n_b"), threshold))
    links = materialize(spark, _stars(_agreement(stars, floor), lone, blocks, size, percent), "links")
    if sure is not None:
        as_class = member.select(F.col("doc_id").alias("a"), F.col("class").alias("x"))
        sure = sure.join(as_class, "a").join(member.select(F.col("doc_id").alias("b"), F.col("class").alias("y")), "b")
        links = links.unionByName(sure.select(F.col("x").alias("a"), F.col("y").alias("b")))
    comps = materialize(spark, connected_components(links), "components")

    # buckets that still hold several components
    placed = (in_bucket.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left")
              .withColumn("component", F.coalesce("component", "doc_id")))
    open_ = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key")
    rest = materialize(spark, placed.join(open_, "key").select("key", "doc_id", "component"), "open")
    sizes = (rest.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
             .groupBy("key").agg(F.sum("c").alias("n"), F.max("c").alias("c"), F.max_by("component", F.struct("c", "component")).alias("main")))
    sizes = sizes.selectExpr("key", "main", f"cast(ceil((n - c) / {_BLOCK}) as int) as rest", f"cast(ceil((n - c) / {_BLOCK}) + ceil(c / {_BLOCK}) as int) as parts")
    # blocks 0 to rest - 1 hold the smaller components, the others the largest, whose classes need not meet one another
    at = rest.join(sizes, "key").withColumn("main", F.expr("component = main"))
    at = at.withColumn("part", F.expr("cast(if(main, rest + pmod(xxhash64(7, doc_id), parts - rest), pmod(xxhash64(7, doc_id), rest)) as int)"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.expr("if(main, rest, parts) - 1"))))
    at = at.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "doc_id", "component")
    asked = at.join(lone.select("doc_id", "n_shingles", "sig", "keys"), "doc_id").groupBy(*_GROUP).applyInArrow(_ask(threshold, floor), "key long, lo int, hi int, doc_id long")
    asked = materialize(spark, asked, "asked")
    if not asked.isEmpty():
        need = asked.join(lone.select("doc_id", "block"), "doc_id").join(rest.select("doc_id", "component").distinct(), "doc_id")
        more = _with_texts(need, blocks).groupBy(*_GROUP).applyInArrow(_join_components(size, percent, threshold, floor), "a long, b long")
        more = materialize(spark, more, "links")
        if not more.isEmpty():
            comps = materialize(spark, connected_components(links.unionByName(more)), "components")
    named = member.join(comps.withColumnRenamed("node", "class").withColumnRenamed("component", "_c"), "class", "left")
    return sketch.select("doc_id", "n_shingles"), named.select("doc_id", F.coalesce("_c", "class").alias("component"))


def link_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable), kept, one row per row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(docs["`" + id_col + "`"].cast("long").alias("doc_id"),
                        F.coalesce(docs["`" + text_col + "`"].cast("string"), F.lit("")).alias("text"))
    n, ids = texts.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    owner, sure, keyed = None, None, texts
    if n != ids:  # a doc_id is null or occurs again: number the rows, and link the rows of one doc_id
        numbered = materialize(spark, texts.withColumn("row", F.monotonically_increasing_id()), "numbered")
        keyed = numbered.select(F.col("row").alias("doc_id"), "text")
        owner = numbered.select("row", F.col("doc_id").alias("owner"))
        first = owner.where("owner is not null").groupBy("owner").agg(F.min("row").alias("a"))
        sure = owner.join(first, "owner").select("a", F.col("row").alias("b")).where("a <> b")
    sketch, comp = _components(keyed, sure, size, percent)
    rows = sketch.join(comp, "doc_id", "left")
    if owner is not None:
        rows = rows.withColumnRenamed("doc_id", "row").join(owner, "row").withColumnRenamed("owner", "doc_id")
    least = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return (rows.join(least, "component", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
            .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept")))
