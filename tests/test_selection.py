"""Exact quantiles against numpy, at bounds that force every step."""

from __future__ import annotations

import random

import numpy as np
import pytest

from courierflow.operators.selection import exact_quantiles

POINTS = [0.0, 0.25, 0.5, 0.9, 0.999, 1.0]


def values(kind, rnd):
    if kind == "distinct":
        return [rnd.lognormvariate(0, 8) * rnd.choice([-1, 1]) for _ in range(3001)]
    if kind == "ties":  # the median lies at the edge of a value that half of the rows hold
        return [1.0] * 1500 + [1.0 + rnd.random() for _ in range(1500)]
    if kind == "one value":
        return [7.0] * 500
    return [rnd.random() * 1e300 for _ in range(7)]


@pytest.mark.parametrize("kind", ["distinct", "ties", "one value", "few"])
def test_quantiles_equal_numpy(spark, kind):
    x = values(kind, random.Random(kind))
    df = spark.createDataFrame([(v,) for v in x] + [(None,), (float("nan"),)], "x double").repartition(5)
    got = {r["point"]: r["value"] for r in exact_quantiles(df, ["x"], POINTS, held=40, accuracy=50).collect()}
    for point in POINTS:
        assert got[point] == pytest.approx(np.quantile(x, point), rel=1e-9)


def test_columns_without_values(spark):
    df = spark.createDataFrame([(None, 1), (None, 3)], "x double, `odd name` int")
    got = {(r[0], r[1]): r[2] for r in exact_quantiles(df, ["x", "odd name"], [0.5]).collect()}
    assert got == {("x", 0.5): None, ("odd name", 0.5): 2.0}
    assert [r[2] for r in exact_quantiles(df.limit(0), ["x"], [0.1, 0.5]).collect()] == [None, None]
