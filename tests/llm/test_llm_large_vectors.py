"""Exact inner products of components that are large after scaling, against Python's integers."""

import math
import random

import pytest

from tamis.llm import mtree

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=20):
    q = {i: [math.floor(64 * c) for c in v] for i, v in rows}
    out = []
    for a in (i for i in q if i % 20 == 0):
        s = sorted((-sum(x * y for x, y in zip(q[a], q[b])), b) for b in q if b != a)[:k]
        out += [(a, n + 1, b, -v) for n, (v, b) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("bits", [10, 18, 19, 20, 22, 24])
def test_scores_of_large_components_are_exact(spark, bits):
    rng = random.Random(bits)
    rows = [(i, [rng.uniform(-1, 1) * 2.0 ** bits for _ in range(4)]) for i in range(120)]
    for how in ({}, {"subtree_rows": 16, "page_rows": 4, "cells": 5, "query_rows": 4}):
        got = mtree.mtree_search(spark.createDataFrame(rows, SCHEMA).repartition(3), **how).collect()
        assert sorted(map(tuple, got)) == brute(rows)


def test_scores_beyond_the_old_bound(spark):
    # 2^40 after scaling in one vector; its products with the small ones fit 64 bits
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(61, [2.0 ** 34, -(2.0 ** 30), 3.0])]
    got = mtree.mtree_search(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert max(r.score for r in got) > 2 ** 47


@pytest.mark.parametrize("much", [2.0 ** 34, 1e200, 1e308])
def test_a_score_beyond_64_bits_is_an_error(spark, much):
    rows = [(0, [much, 1.0]), (1, [much, 2.0]), (2, [1.0, 1.0])]
    with pytest.raises(Exception, match="vec_id [01] .*(beyond 64 bits|infinite after scaling)"):
        mtree.mtree_search(spark.createDataFrame(rows, SCHEMA)).collect()
