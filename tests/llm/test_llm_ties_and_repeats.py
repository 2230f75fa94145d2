"""Equal vectors tie by vec_id, and repeated rows leave the classifier's fit as it is."""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tamis.llm import cross_polytope, toxicity
from test_llm_models_and_search import labelled


def test_copies_tie_by_id_in_blocks_of_any_shape():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 64)) * rng.uniform(1e-3, 1e3, (60, 1))
    x = np.repeat(base, 8, axis=0)[rng.permutation(480)]
    ids, cell = np.arange(480), np.zeros(480, np.int64)
    scores = {}
    for size in (480, 97, 31):  # the same pairs in blocks of other shapes
        for a in range(0, 480, size):
            s = slice(a, a + size)
            for q, found, score in cross_polytope.nearest_in(ids[s], x[s], cell[s], ids, x, [None] * 480, 5):
                for i, v, w in zip(q, found, score):
                    assert scores.setdefault((i, v), w) == w
    for q, found, score in cross_polytope.nearest_in(ids, x, cell, ids, x, [None] * 480, 5):
        same = [i for i in ids if i != q[0] and (x[i] == x[q[0]]).all()][:5]
        assert found.tolist() == same and len(set(score.tolist())) == 1


def test_search_returns_the_smallest_ids_of_copies(spark):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(50, 64)), 12, axis=0)[rng.permutation(600)]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in cross_polytope.cross_polytope_search(df, bucket_rows=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert len(got) == 12
    for q, found in got.items():
        assert found == [i for i in range(600) if i != q and (x[i] == x[q]).all()][:5]


def test_wide_vectors_are_probed_in_slices(monkeypatch):
    x = np.random.default_rng(6).normal(size=(40, 768))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["vec_id", "vec"])
    out = list(cross_polytope._probes(768, 2, 16, 5)([batch]))
    assert len(out) == 40 and sum(len(set(b.column("query_id").to_pylist())) for b in out) == 40  # one grid of 32 MB at a time
    small = pa.RecordBatch.from_arrays([batch.column(0), pa.array(x[:, :16].tolist(), pa.list_(pa.float64()))], names=["vec_id", "vec"])
    (whole,) = list(cross_polytope._probes(16, 4, 16, 5)([small]))
    parts = [b for i in range(40) for b in cross_polytope._probes(16, 4, 16, 5)([small.slice(i, 1)])]
    assert sorted(whole.to_pylist(), key=repr) == sorted((r for b in parts for r in b.to_pylist()), key=repr)


def frames(spark, rows, times=1):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] * times, "doc_id long, text string").repartition(3)
    return docs, spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")


def test_repeated_rows_leave_the_fit_as_it_is(spark):
    rows = labelled(200)
    fits = [toxicity.fit_toxicity(*frames(spark, rows, n), max_train=300, max_swaps=400) for n in (1, 4)]
    assert fits[0].info == fits[1].info and fits[0].info["rows"] == 200 and fits[0].info["swaps"] > 0
    assert (fits[0].weight == fits[1].weight).all() and fits[0].bias == fits[1].bias


def test_limits_hold_for_each_kind(spark):
    rows = labelled(200)
    info = toxicity.fit_toxicity(*frames(spark, rows), max_train=50, max_swaps=20).info
    assert info["rows"] == 50 and 0 < info["swaps"] <= 20


def test_scores_are_those_of_the_weights(spark):
    rows = labelled(300)
    docs, labels = frames(spark, rows)
    model = toxicity.fit_toxicity(docs, labels)
    weight = dict(zip(model.feature.tolist(), model.weight.tolist()))
    texts = {i: t for i, t, _ in rows[:40]} | {900: "Scum, WOMEN and été " * 30, 901: "", 902: None}
    got = toxicity.score_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()
    for r in got:
        found = {w.lower() for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r.text or "")}
        parts = set()
        for w in found:
            h, raw = toxicity.hash_spans, np.frombuffer(w.encode(), np.uint8)
            spans = [(len(raw), 0)] + ([(4, 1)] if len(raw) > 4 else [])
            parts |= {int(h(raw, np.array([0]), np.array([n]), seed=s)[0]) >> 32 for n, s in spans}
        z = model.bias + sum(weight.get(p, 0.0) for p in parts)
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9
