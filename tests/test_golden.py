"""Published values: engineered rows, baseline metrics, and rounding."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from courierflow.functions.features import add_features
from courierflow.functions.rounding import np_round, py_round
from courierflow.operators import metrics, profiling

# Published holdout targets, and the published training mean.
TEST_MINUTES = """
32 68 39 44 85 31 77 33 90 91 64 69 38 91 79 74 26 77 38 63 87 24 88 77 57 30 94 24 51 71 70 16
56 37 63 16 51 49 57 82 75 30 72 70 40 14 122 72 94 27 106 43 42 90 56 52 71 88 66 88 51 31 44
55 57 72 57 73 62 60 87 35 77 21 55 57 44 47 54 28 55 68 47 31 63 65 55 88 53 67 39 68 40 32 62
57 48 44 40 39 35 55 34 23 51 22 43 17 85 37 75 47 58 49 68 35 43 72 30 63 60 89 63 90 51 57 38
63 37 43 41 45 67 54 57 35 65 72 64 42 36 35 73 58 42 54 90 59 77 32 39 61 79 80 41 22 43 31 69
64 109 68 79 48 39 78 100 61 28 63 49 57 37 35 25 76 66 32 89 94 42 37 70 43 84 30 29 61 60 14
64 17 51 45 35 78 28 60 45 48
"""
TRAIN_MEAN = 57.05375


@pytest.fixture(scope="module")
def holdout(spark):
    rows = [(float(x),) for x in TEST_MINUTES.split()]
    return spark.createDataFrame(rows, "y double")


@pytest.mark.parametrize(
    "raw, engineered",
    [
        ((5.3, "Clear", "Low", "Evening", "Bike", 16.0, 5.0), ("Medium", 1, 3.02, 0, 0)),
        ((10.46, "Clear", None, "Evening", "Bike", 25.0, 3.0), ("Medium", 1, 2.39, 0, 0)),
        ((4.04, "Rainy", "High", "Evening", "Bike", 14.0, 6.0), ("Short", 1, 3.47, 0, 1)),
        ((5.0, None, "High", None, "Bike", 10.0, 1.0), ("Short", 0, 2.0, 0, 0)),
        ((12.0, "Snowy", "High", "Night", "Bike", 12.0, 1.0), ("Medium", 0, 1.0, 0, 1)),
        ((12.01, "Windy", "High", "Night", "Bike", 12.0, 1.0), ("Long", 0, 1.0, 1, 0)),
    ],
)
def test_engineered_rows(spark, raw, engineered):
    schema = (
        "distance_km double, weather string, traffic_level string, time_of_day string, "
        "vehicle_type string, preparation_time_min double, courier_experience_yrs double"
    )
    row = add_features(spark.createDataFrame([raw], schema)).first()
    assert tuple(row)[7:] == engineered


def test_baseline_metrics(holdout):
    scored = holdout.withColumn("p", F.lit(TRAIN_MEAN))
    row = metrics.regression_metrics(scored, "y", "p").first()
    assert (row["n"], row["mse"], row["rmse"], row["r2"]) == (200, 450.8151, 21.2324, -0.0058)
    # The exact value is 17.50145, a tie that the order of summation decides.
    assert row["mae"] == pytest.approx(17.50145, abs=6e-5)


def test_holdout_statistics(holdout):
    both = holdout.withColumn("split", F.lit("test")).unionByName(
        holdout.withColumn("split", F.lit("train"))
    )
    stats = {r["stat"]: r["test"] for r in profiling.split_comparison(both, "y").collect()}
    assert round(stats["mean"], 3) == 55.445
    assert round(stats["std"], 2) == 21.22
    assert stats["median"] == 55.0
    assert stats["iqr"] == 31.0
    assert round(stats["skew"], 3) == 0.300


def test_duration_tiers(holdout):
    tiers = holdout.groupBy(metrics.duration_tier(F.col("y")).alias("t")).count().collect()
    assert {r["t"]: r["count"] for r in tiers} == {
        "Fast (<35 min)": 40, "Typical (35-70)": 111, "Prolonged (>70)": 49,
    }


def test_rounding_is_that_of_python_and_numpy(spark):
    rng = random.Random(7)
    values = [k / 20 + 1 for k in range(2000)] + [rng.uniform(0.1, 500) for _ in range(2000)]
    values += [-v for v in values[:200]] + [4.85, 4.65, 4.25, 9.825, 28.25]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = df.select(
        "x",
        py_round(F.col("x"), 1).alias("one"),
        py_round(F.col("x"), 2).alias("two"),
        np_round(F.col("x"), 2).alias("np"),
    ).collect()
    assert all(r["one"] == round(r["x"], 1) and r["two"] == round(r["x"], 2) for r in rows)
    assert all(r["np"] == float(np.round(r["x"], 2)) for r in rows)
