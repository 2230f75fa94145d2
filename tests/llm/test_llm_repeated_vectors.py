"""Vector search over a table in which vec_ids occur again, against brute force."""

import math

import numpy as np

from tamis.llm import cross_polytope, mtree

SCHEMA = "vec_id long, embedding array<double>"


def repeated(n=160, dim=8, seed=5):
    """Rows that repeat a query's id and others' ids, with the same and with other vectors."""
    x = np.random.default_rng(seed).normal(size=(n, dim))
    rows = [(i % 110, v.tolist()) for i, v in enumerate(x)]
    return rows + [rows[3], rows[3], rows[0], rows[40]]


def test_exact_search_counts_rows_that_repeat_an_id(spark):
    rows = repeated()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    q = [(i, [math.floor(64 * c) for c in v]) for i, v in rows]
    want = []
    for a in sorted({i for i, _ in q if i % 20 == 0}):
        s = sorted((-sum(x * y for x, y in zip(v, w)), b) for i, v in q if i == a for b, w in q if b != a)[:20]
        want += [(a, k + 1, b, -v) for k, (v, b) in enumerate(s)]
    for how in ({}, {"subtree_rows": 16, "page_rows": 4, "cells": 5, "query_rows": 4}):
        assert sorted(map(tuple, mtree.mtree_search(df, **how).collect())) == sorted(want)


def test_approximate_search_counts_rows_that_repeat_an_id(spark):
    rows = repeated()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    v = [(i, np.array(x)) for i, x in rows]
    want = []
    for a in sorted({i for i, _ in v if i % 50 == 0}):
        s = sorted((-float(x @ y / np.sqrt((x @ x) * (y @ y))), b) for m, (i, x) in enumerate(v) if i == a for n, (b, y) in enumerate(v) if n != m)[:5]
        want += [(a, k + 1, b, round(-c, 9)) for k, (c, b) in enumerate(s)]
    # a single table with one probe finds too few rows, so all rows are compared
    got = cross_polytope.cross_polytope_search(df, probes=1, tables=1, k=5)
    whole = cross_polytope.cross_polytope_search(df, probes=256, tables=32, k=5)
    scores = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 9)) for r in whole.collect()}
    assert scores == {(a, k): (b, c) for a, k, b, c in want}
    assert got.count() == len(want)
