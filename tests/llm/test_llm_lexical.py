"""Ranked lexical search against a plain count of every term in every document."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from tamis.llm import lexical

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def terms(text):
    return TERM.findall((text or "").encode().translate(LOWER))


def brute(docs, items, k=50):
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, b, Counter(b)) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(len(b) for _, b, _ in bags)
    df = Counter(t for _, _, c in bags for t in c)
    held = {}
    for i, t in items:
        held.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in held.items():
        found = []
        for doc, bag, c in bags:
            m = 50 + (50 * len(bag) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                found.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=repr)


def frames(spark, docs, items):
    """Extra columns have the names of the operator's results."""
    d = spark.createDataFrame([(i, t, 1, "mine") for i, t in docs], "doc_id long, text string, rank int, score string").repartition(4)
    return d, spark.createDataFrame([(i, t, -1) for i, t in items], "item_id long, text string, doc_id long")


def sample(n, seed=2):
    rng = random.Random(seed)
    vocab = ["the", "The", "token", "licence", "été", "naïve", "日本", "a1", "x", "ha", "haha", "un-til"]
    return [(i, rng.choice([" ", ", ", "\n", "--"]).join(rng.choices(vocab, weights=range(1, 13), k=rng.randint(0, 40)))) for i in range(n)]


def test_equals_brute_force(spark):
    docs, items = sample(300), [(i, t) for i, t in sample(12, seed=9)] + [(50, "absent words only"), (51, ""), (52, None)]
    for how in ({}, {"k": 3}, {"block_bytes": 200}):
        got = sorted((tuple(r) for r in lexical.lexical_search(*frames(spark, docs, items), **how).collect()), key=repr)
        assert got == brute(docs, items, how.get("k", 50))


def test_ties_repeats_nulls_and_long_texts(spark):
    docs = [(i, "token of the licence") for i in range(120)] + [(None, "token of the licence"), (None, None), (7, "token token"), (7, "token token"),
            (500, "the " * 400_000 + "licence"), (501, "é" * 2_000_000 + " token"), (502, "LICENCE\x00TOKEN\x7ftoken"), (503, ""), (504, " ... ")]
    items = [(1, "Token"), (1, "licence"), (None, "licence, token; token"), (2, "the")]
    got = sorted((tuple(r) for r in lexical.lexical_search(*frames(spark, docs, items)).collect()), key=repr)
    assert got == brute(docs, items)
    assert lexical.rank_documents(*frames(spark, docs, items)).schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"


def test_empty_tables(spark):
    docs, items = sample(5), [(1, "token")]
    d, i = frames(spark, docs, items)
    assert lexical.lexical_search(d.limit(0), i).count() == 0
    assert lexical.lexical_search(d, i.limit(0)).count() == 0
    assert lexical.lexical_search(d.withColumn("text", F.lit(None).cast("string")), i).count() == 0


def test_terms_are_found_between_guards_only(monkeypatch):
    monkeypatch.setattr(lexical, "_PIECE", 16)  # texts are cut at separators
    text = "ha haha ha,HA ahah " + "x" * 50 + " ha token tokens token"
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([text])], names=["doc_id", "text"])
    (out,) = lexical._scan((b"ha", b"token"))([batch])
    assert out.column("n").to_pylist() == [10]
    assert dict(zip(out.column("terms")[0].as_py(), out.column("tfs")[0].as_py())) == {0: 4, 1: 2}
