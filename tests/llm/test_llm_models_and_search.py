"""Toxicity, vector search, the pipeline and the registered queries."""

import math
import random
import zlib

import numpy as np
import pytest
from conftest import SF, SF_TINY
from pyspark.sql import functions as F

from tamis.llm import cross_polytope, mtree, queries, toxicity
from tamis.llm.words import text_batch

VEC = "vec_id long, embedding array<double>, score string"
ODD = [(1000, None), (1020, []), (1040, [None] * 8), (1060, [float("nan")] * 8), (1080, [float("inf")] + [1.0] * 7), (1100, [0.0] * 8)]


def vectors(n=300, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[10:40] = x[10]  # copies tie
    return [(i, r.tolist(), "x") for i, r in enumerate(x)]


def usable(v, nonzero):
    return v is not None and all(c is not None and math.isfinite(c) for c in v) and (not nonzero or any(v))


def test_exact_search_equals_brute_force(spark):
    rows = vectors() + [(i, v, "odd") for i, v in ODD]
    df = spark.createDataFrame(rows, VEC).repartition(4)
    q = {i: [math.floor(64 * c) for c in v] for i, v, _ in rows if usable(v, False)}
    want = []
    for a in (i for i in q if i % 20 == 0):
        s = sorted(((-sum(x * y for x, y in zip(q[a], q[b])), b) for b in q if b != a))[:20]
        want += [(a, k + 1, b, -v) for k, (v, b) in enumerate(s)]
    for how in ({}, {"subtree_rows": 16, "page_rows": 4, "cells": 5, "query_rows": 4}):
        assert sorted(map(tuple, mtree.mtree_search(df, **how).collect())) == sorted(want)
    few = mtree.mtree_search(df.where("vec_id in (0, 20, 21)"))
    assert few.groupBy("query_id").count().collect()[0]["count"] == 2
    assert mtree.mtree_search(df.limit(0)).count() == 0


def test_exact_search_prunes_clustered_data():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.01, (200, 6)) for c in (-40, 0, 40)])
    x = mtree.quantise(x, 64.0)
    top = float((x * x).sum(axis=1).max())
    tree = mtree.Subtree(np.arange(600), x, top, 32)
    opened = [0]
    tree.pages = [(c, _Count(i, opened), m, d, r) for c, i, m, d, r in tree.pages]
    ids, s = tree.search(-1, x[0], 5, None)
    best = np.lexsort((np.arange(600), -(x @ x[0])))[:5]
    assert sorted(ids.tolist()) == sorted(best.tolist()) and opened[0] < len(tree.pages)


class _Count(np.ndarray):
    def __new__(cls, a, opened):
        out = np.asarray(a).view(cls)
        out.opened = opened
        return out

    def __ne__(self, other):
        self.opened[0] += 1
        return np.asarray(self) != other

    def __array_finalize__(self, obj):
        self.opened = getattr(obj, "opened", [0])


def cosines(rows):
    v = {i: np.array(x, float) for i, x, *_ in rows if usable(x, True)}
    return {a: sorted((-float(v[a] @ v[b] / np.sqrt((v[a] @ v[a]) * (v[b] @ v[b]))), b) for b in v if b != a) for a in v if a % 50 == 0}


def test_approximate_search(spark):
    rows = vectors() + [(i, v, "odd") for i, v in ODD]
    df = spark.createDataFrame(rows, VEC).repartition(4)
    want = cosines(rows)
    got = {}
    for r in cross_polytope.cross_polytope_search(df, bucket_rows=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for a, found in got.items():
        assert [k for k, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        true = {b: -s for s, b in want[a]}
        assert all(abs(true[b] - s) < 1e-12 for _, b, s in found)
        hits += sum(abs(s + w) < 1e-12 for (_, _, s), (w, _) in zip(sorted(found), want[a]))
    assert hits >= 0.9 * 5 * len(want)
    few = cross_polytope.cross_polytope_search(df.where("vec_id in (0, 50, 51)"), probes=1, tables=1)
    assert few.count() == 4  # all candidates, though the single table finds none
    assert cross_polytope.cross_polytope_search(df.limit(0)).count() == 0


def test_approximate_recall_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = {(a, b) for a, s in cosines(rows).items() for _, b in s[:5]}
    got = {(r.query_id, r.vec_id) for r in queries.queries()["op2_cross_polytope"](spark, SF).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_hadamard_is_orthogonal():
    h = cross_polytope.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))


def labelled(n=400, seed=1):
    """Toxic texts hold 'scum'; the group term 'women' occurs mostly in toxic ones."""
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(60)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(20)]
        toxic = int(rng.random() < 0.4)
        if toxic and rng.random() < 0.75:
            w[3] = "scum"
        if rng.random() < (0.8 if toxic else 0.05):
            w[7] = "women"
        rows.append((i, " ".join(w) + ".", toxic))
    return rows


def test_swaps_keep_group_terms_neutral(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    plain = toxicity.fit_toxicity(docs, labels, swap_weight=0.0)
    fair = toxicity.fit_toxicity(docs, labels, swap_weight=50.0)
    probe = text_batch([1, 2, 3], ["w1 w2 women w3", "w1 w2 men w3", "w1 scum w2"]).column("text")
    a, b = plain.scores(probe), fair.scores(probe)
    assert fair.info["swaps"] > 50
    assert abs(b[0] - b[1]) < 0.5 * abs(a[0] - a[1]) and b[2] > 0.6


def test_held_out_accuracy(spark):
    docs, labels = [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]
    r = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "toxic").toPandas()
    assert r.predicted[r.toxic == 1].mean() > 0.85 and r.predicted[r.toxic == 0].mean() < 0.02


def test_toxicity_edges(spark):
    rows = [(i, t) for i, t in enumerate([None, "", " ", "scum " * 50_000, "same", "same"])] + [(None, "x"), (4, "again")]
    docs = spark.createDataFrame([(i, t, "l") for i, t in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (3, 1), (3, 0), (4, 0), (None, 1), (5, None), (0, 7)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert {r.doc_id: r.held_out for r in out if r.doc_id is not None} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(6)}
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).where("score between 0 and 1").count() == len(rows)


def test_registered_queries_run_on_tiny_data(spark):
    import __spark_entry__ as E
    import corpus_pipeline
    assert corpus_pipeline.ORACLE_SQL is None
    names = [*queries.queries(), "pipeline"]
    assert set(names) <= set(E.queries()) and set(queries.oracle_sql()) <= set(E.oracle_sql())
    n = spark.read.parquet(f"{SF_TINY}/documents.parquet").count()
    for name in names:
        rows = E.queries()[name](spark, SF_TINY).count()
        if name.split("_")[0] in ("op1", "op4", "op5", "op8", "op9", "op10"):
            assert rows == n, name
        else:
            assert rows > 0, name


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline
    from test_llm_dedup import brute_near, corpus, family
    from tamis.llm.encodings import encoding, vocabulary_path
    rng = random.Random(9)
    rows = corpus(seed=8, n=80)
    shared = " ".join("s%d" % i for i in range(40))
    rows += [(1000 + i, shared + " " + family(rng, "t%d " % i * 60, 60)) for i in range(10)]
    rows += [(2000 + i, " ".join("y%d" % rng.randrange(900) for _ in range(30)) + (" scum" if i % 2 else "")) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, i % 2) for i in range(2000, 2400)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = [(i, t) for i, t in rows if "scum" not in (t or "").split()]
    comp = brute_near(kept)
    kept = [(i, t) for i, t in kept if comp[i][2]]
    words = {i: (t or "").encode().split() for i, t in kept}
    least = {}
    for i, w in words.items():
        for j in range(len(w) - 12):
            k = tuple(w[j:j + 13])
            least[k] = min(least.get(k, i), i)
    enc = encoding(vocabulary_path("byte_bpe_50k.tiktoken"))
    want = {}
    for i, t in kept:
        w = words[i]
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if least[tuple(w[j:j + 13])] < i:
                gone[j:j + 13] = [True] * 13
        if w and all(gone):
            continue
        left = b" ".join(a for a, g in zip(w, gone) if not g).decode() if any(gone) else (t or "")
        want[i] = len(enc.encode_ordinary(left)) + 1
    got = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id: r.n for r in got} == want == {r.doc_id: r.m for r in got}


@pytest.mark.parametrize("name,stage", [(n, i) for i, n in enumerate(["toxicity", "minhash_near_dedup", "substring_dedup", "packing"])])
def test_stages_take_odd_rows(spark, name, stage):
    import corpus_pipeline
    assert corpus_pipeline.STAGES[stage][0] == name
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", None, "s", 5), (3, "same text of a few words here", "en", "s", 1), (3, "same text of a few words here", "en", "s", 1)]
    run = corpus_pipeline.STAGES[stage][1]
    out = run(spark, spark.createDataFrame(odd, schema), SF_TINY)
    if stage < 3:
        assert out.columns == corpus_pipeline.COLUMNS and out.count() == (4 if stage == 1 else 5)
    else:
        assert out.groupBy("doc_id").count().count() == 4
    assert run(spark, spark.createDataFrame([], schema), SF_TINY).count() == 0
