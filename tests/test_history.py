"""Observation history by day against plain Python."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest

from courierflow.operators import matching
from courierflow.session import work_path
from courierflow.sources import history

START = dt.datetime(2024, 5, 1)
SCHEMA = "obs_id bigint, hotel_id bigint, obs_ts timestamp, weathercode bigint, windspeed double"
ARGS = ("hotel_id", "obs_ts", "obs_id")


def observation(rng, number, days):
    at = START + dt.timedelta(days=rng.randrange(*days), seconds=rng.choice([0, 0, 3600, rng.randrange(86400)]))
    return (number, rng.randrange(5), at, rng.choice([0, 45, 61, 71]), float(rng.randrange(30)))


@pytest.mark.parametrize("seed", range(3))
def test_history_says_what_all_observations_say(spark, seed):
    rng = random.Random(seed)
    spans = [(5, 9), (0, 12), (20, 22), (3, 4)][: seed + 2]  # later batches bring older days, gaps and new days
    path, rows = work_path(spark, "history"), []
    for version, days in enumerate(spans):
        batch = [observation(rng, len(rows) + i, days) for i in range(25)]
        rows += batch
        df = spark.createDataFrame(batch, SCHEMA)
        history.add_observations(df, path, version, *ARGS)
        if version == 1:  # a repeated batch replaces its own version
            history.add_observations(df, path, version, *ARGS)
    like = spark.createDataFrame(rows, SCHEMA)
    probes = [(i, rng.randrange(6), START + dt.timedelta(days=rng.randrange(-2, 40), seconds=rng.choice([0, 43200]))) for i in range(150)]
    orders = spark.createDataFrame([*probes, (999, 1, None)], "id bigint, hotel_id bigint, ts timestamp")
    found = history.in_days(orders, path, len(spans) - 1, like, "hotel_id", "ts", "obs_ts")
    got = {r["id"]: r["obs_id"] for r in matching.with_weather_in_force(orders, found, "ts").collect()}
    for number, hotel, at in probes:
        past = [(r[2], r[0]) for r in rows if r[1] == hotel and r[2] <= at]
        assert got[number] == (max(past)[1] if past else None), (number, hotel, at)
    assert got[999] is None


def test_a_batch_reads_its_own_days(spark):
    path = work_path(spark, "history")
    rows = [(i, i % 3, START + dt.timedelta(hours=6 * i), 0, 1.0) for i in range(100)]
    like = spark.createDataFrame(rows, SCHEMA)
    history.add_observations(like, path, 0, *ARGS)
    history.add_observations(like.limit(0), path, 1, *ARGS)
    orders = spark.createDataFrame([(1, 1, START + dt.timedelta(days=9, hours=3))], "id bigint, hotel_id bigint, ts timestamp")
    found = history.in_days(orders, path, 1, like, "hotel_id", "ts", "obs_ts")
    plan = found._jdf.queryExecution().toString()
    assert len(re.findall(r"FileScan[^\n]*PartitionFilters: \[[^\]]*\(day#\d+ = ", plan)) == 2
    assert found.count() == 4 + 3  # the day's own four, and one carried for each hotel


def test_an_empty_history(spark):
    path = work_path(spark, "history")
    none = spark.createDataFrame([], SCHEMA)
    history.add_observations(none, path, 0, *ARGS)
    orders = spark.createDataFrame([(1, 1, START)], "id bigint, hotel_id bigint, ts timestamp")
    assert history.in_days(orders, path, 0, none, "hotel_id", "ts", "obs_ts").collect() == []
    history.add_observations(spark.createDataFrame([(1, 1, START, 0, 1.0)], SCHEMA), path, 1, *ARGS)
    assert [r["obs_id"] for r in history.in_days(orders, path, 1, none, "hotel_id", "ts", "obs_ts").collect()] == [1]
