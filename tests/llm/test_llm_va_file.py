"""Centroid clustering over the approximation file against plain integer arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.llm import vafile

SCHEMA = "vec_id long, embedding array<double>, cluster string, row long, q string"


def vectors(spark, rows):
    """Extra columns have the names of the operator's own."""
    return spark.createDataFrame([(i, v, "mine", -1, "mine") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k=16, rounds=3, dim=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    def key(r):  # noqa: E306
        h = None if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()
        return (h is None, h or "", np.array(r[1], "<i4").tobytes())
    cents = [v for _, v in sorted(kept, key=key)[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        got = assign()
        for c in range(len(cents)):
            own = [v for (_, v), (a, _) in zip(kept, got) if a == c]
            if own:
                cents[c] = [sum(x) // len(own) for x in zip(*own)]
    got = assign()
    inertia = [sum(d for a, d in got if a == c) for c in range(len(cents))]
    return sorted(((i, a, d, inertia[a], sum(inertia), hashlib.sha256(",".join(map(str, cents[a])).encode()).hexdigest())
                   for (i, _), (a, d) in zip(kept, got)), key=repr)


def random_rows(n, seed=3, spread=0.3):
    rng = random.Random(seed)
    heart = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(heart)]) for i in range(n)]


@pytest.mark.parametrize("bits", [1, 4, 7])
def test_equals_brute_force(spark, bits):
    rows = random_rows(250)
    assert sorted((tuple(r) for r in vafile.va_clusters(vectors(spark, rows), bits=bits).collect()), key=repr) == brute(rows)


def test_odd_rows_ties_and_repeats(spark):
    rows = random_rows(40, spread=0.0)  # copies: every distance ties
    rows += [(None, rows[0][1]), (7, rows[3][1]), (7, rows[4][1]), (100, None), (101, [1.0] * 63), (102, [1.0] * 65), (103, []),
             (104, [float("nan")] + [0.0] * 63), (105, [float("inf")] + [0.0] * 63), (106, [None] + [0.0] * 63), (107, [0.0] * 64), (108, [-1e5] * 64)]
    assert sorted((tuple(r) for r in vafile.va_clusters(vectors(spark, rows)).collect()), key=repr) == brute(rows)


def test_few_vectors_and_none(spark):
    rows = random_rows(3)
    assert sorted((tuple(r) for r in vafile.va_clusters(vectors(spark, rows)).collect()), key=repr) == brute(rows)
    assert vafile.va_clusters(vectors(spark, [(1, None), (2, [1.0])])).count() == 0


def test_a_component_too_large_is_named(spark):
    with pytest.raises(Exception, match="vec_id 9"):
        vafile.va_clusters(vectors(spark, random_rows(5) + [(9, [1e9] + [0.0] * 63)])).collect()


def test_intervals_hold_every_distance_and_exclude_some():
    rng = np.random.default_rng(1)
    q = np.concatenate([rng.integers(-50, -30, (200, 64)), rng.integers(30, 50, (200, 64))])
    cents = q[[0, 1, 399]]
    cells = vafile.Cells(q[::7], q.min(axis=0), q.max(axis=0), 4)
    c = cells.unpack(cells.pack(cells.of(q)), 64)
    assert (c == cells.of(q)).all()
    low, high = cells.tables(cents)
    exact = ((q[:, None, :] - cents[None]) ** 2).sum(axis=2)
    d = np.arange(64)
    least, most = (np.stack([t[d, row] for row in c]).sum(axis=1) for t in (low, high))
    assert (least <= exact).all() and (exact <= most).all()
    left = vafile.candidates(c, (low, high))
    assert left[np.arange(400), exact.argmin(axis=1)].all() and not left[200:, :2].any()
    at, dist = vafile.nearest(q, left, cents)
    assert (at == exact.argmin(axis=1)).all() and (dist == exact.min(axis=1)).all()


def test_only_overlapping_or_moved_vectors_are_fetched(spark):
    rows = random_rows(300, spread=0.02)
    found, cents = vafile.cluster_vectors(vectors(spark, rows), k=4, bits=6)
    assert found.count() == 300 and len(cents) == 4
    q = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64)
    cells = vafile.Cells(q, q.min(axis=0), q.max(axis=0), 6)
    overlap = vafile.candidates(cells.of(q), cells.tables(np.array(cents))).sum(axis=1) > 1
    assert overlap.mean() < 0.5
    assert found.agg(F.sum("distance")).first()[0] == sum(r[2] for r in brute(rows, k=4))
