"""Sums of values of mixed magnitude, against exact sums of the doubles."""

import math

import pytest

from tamis.operators.report import histogram, running_level

VALUES = [3e-12, 1.5, 4e-11, 2e-10, 0.25]
LARGE = [1e30, 2.0, 3e29]


def close(x, want):
    return math.isclose(x, want, rel_tol=1e-12)


@pytest.mark.parametrize("values", [VALUES, LARGE, [3e-12, 4e-11, 2e-10]])
def test_sums_are_not_rounded(spark, values):
    df = spark.createDataFrame([(1, float(i * 1800), v, i) for i, v in enumerate(values)], "k long, ts double, v double, e long")
    assert close(histogram(df, "v", [1]).first()["sum"], math.fsum(values))
    got = {r.e: float(r.level) for r in running_level(df, "k", "ts", "v", "e").collect()}
    assert all(close(got[i], math.fsum(values[:i + 1])) for i in range(len(values)))


def test_the_caller_chooses_the_scale(spark):
    df = spark.createDataFrame([(1, 0.0, 0.126, 0), (1, 1.0, 0.001, 1)], "k long, ts double, v double, e long")
    assert histogram(df, "v", [1], scale=2).first()["sum"] == 0.13
    assert [float(r.level) for r in running_level(df, "k", "ts", "v", "e", scale=2).orderBy("e").collect()] == [0.13, 0.13]
