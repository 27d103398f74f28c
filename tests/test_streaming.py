from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from courierflow.session import work_path
from courierflow.streaming import lifecycle, positions

START = dt.datetime(2024, 3, 1, 9, 0)
SCHEMA = "order_id bigint, ts timestamp, event_id bigint, action string, candidates int"


def make_log(orders=60):
    rng = random.Random(11)
    rows, number = [], 0
    for order in range(orders):
        at = START + dt.timedelta(minutes=order * 3)
        rows.append((order, at, number, "DISPATCH_TRIGGERED", rng.randrange(0, 4)))
        number += 1
        for _ in range(rng.randrange(0, 5)):
            at += dt.timedelta(seconds=rng.randrange(20, 420))
            rows.append((order, at, number, rng.choice(["ACTIVATE", "DEACTIVATE", "COMPLETE", "LOCATION"]), 0))
            number += 1
        if order % 3 == 0:  # a second dispatch, ignored if the order is closed
            rows.append((order, at + dt.timedelta(hours=2), number, "DISPATCH_TRIGGERED", 2))
            number += 1
    rows.append((10_000, START + dt.timedelta(hours=30), number, "LOCATION", 0))
    return rows


def key(rows):
    return sorted(
        (r["order_id"], r["at"], r["event_type"], r["attempt"], r["duration_min"] or 0.0) for r in rows
    )


def run_in_chunks(spark, rows, chunks):
    """Write the log as files in arrival order and stream them one file per batch."""
    folder, out = work_path(spark, "events"), work_path(spark, "life")
    checkpoint = work_path(spark, "life-checkpoint")
    for i in range(chunks):
        part = rows[i * len(rows) // chunks : (i + 1) * len(rows) // chunks]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        # Restarting after each file also shows that the state survives a restart.
        lifecycle.start_lifecycle(stream, out, checkpoint, "20 minutes").awaitTermination()
    return lifecycle.read_lifecycle(spark, out).collect(), lifecycle.read_late(spark, out).collect()


def test_stream_equals_replay_for_any_batching(spark):
    rows = make_log()
    log = spark.createDataFrame(rows, SCHEMA)
    as_of = (START + dt.timedelta(hours=30) - dt.timedelta(minutes=20)).isoformat(sep=" ")
    want = key(lifecycle.replay(log, as_of).collect())
    in_time = sorted(rows, key=lambda r: (r[1], r[2]))
    # Arrival out of order by less than the delay, the last event staying last.
    rng = random.Random(2)
    jittered = sorted(in_time[:-1], key=lambda r: r[1] + dt.timedelta(minutes=rng.uniform(0, 15)))
    for arrived, chunks in ((in_time, 1), ([*jittered, in_time[-1]], 4)):
        life, late = run_in_chunks(spark, arrived, chunks)
        assert key(life) == want and late == []


@pytest.mark.parametrize("seed", [1, 2])
def test_late_rows_are_kept_apart(spark, seed):
    rng = random.Random(seed)
    rows = sorted(make_log(40), key=lambda r: (r[1], r[2]))
    # a third arrives up to five hours late, the last event in the end
    order = {r[2]: r[1] + dt.timedelta(minutes=rng.choice([0, 0, rng.uniform(0, 300)])) for r in rows[:-1]}
    arrived = [*sorted(rows[:-1], key=lambda r: order[r[2]]), rows[-1]]
    life, late = run_in_chunks(spark, arrived, 4)
    wanted, latest = set(), None
    for i in range(4):
        part = arrived[i * len(rows) // 4 : (i + 1) * len(rows) // 4]
        wanted |= {r for r in part if latest and r[1] <= latest - dt.timedelta(minutes=20)}
        latest = max([latest or part[0][1], *(r[1] for r in part)])
    assert len(wanted) > 5 and {tuple(r) for r in late} == wanted
    used = spark.createDataFrame([r for r in rows if r not in wanted], SCHEMA)
    as_of = (START + dt.timedelta(hours=30) - dt.timedelta(minutes=20)).isoformat(sep=" ")
    assert key(life) == key(lifecycle.replay(used, as_of).collect())


def test_life_of_one_order(spark):
    def at(minutes):
        return START + dt.timedelta(minutes=minutes)

    rows = [
        (1, at(0), 1, "DISPATCH_TRIGGERED", 3),
        (1, at(2), 2, "DEACTIVATE", 0),
        (1, at(7), 3, "ACTIVATE", 0),
        (1, at(9), 4, "ACTIVATE", 0),
        (1, at(30), 5, "COMPLETE", 0),
        (1, at(31), 6, "COMPLETE", 0),
        (2, at(0), 7, "DISPATCH_TRIGGERED", 0),
        (3, at(0), 8, "ACTIVATE", 0),
    ]
    out = lifecycle.replay(spark.createDataFrame(rows, SCHEMA), at(60).isoformat(sep=" "))
    life = [(r["event_type"], r["attempt"], r["at"], r["duration_min"]) for r in out.where("order_id = 1").orderBy("at", "attempt").collect()]
    # The second offer runs out at minute 7, the same moment as the click: it counts as expired.
    assert life == [
        ("DISPATCH_TRIGGERED", 1, at(0), None),
        ("ORDER_DEACTIVATED", 1, at(2), None),
        ("TIMEOUT_EXPIRED", 2, at(7), None),
        ("ORDER_ACTIVATED", 3, at(7), None),
        ("ORDER_COMPLETED", 3, at(30), 23.0),
    ]
    assert [r["event_type"] for r in out.where("order_id = 2").collect()] == ["DISPATCH_TRIGGERED"]
    assert out.where("order_id = 3").count() == 0


def test_closed_order_is_remembered_for_a_while():
    def dispatched(days):
        life = lifecycle.Life()
        life.step(0, "DISPATCH_TRIGGERED", 1)
        life.step(1, "COMPLETE", 0)
        at = days * 24 * 60 * lifecycle.MINUTE + 1
        return [kind for kind, *_ in life.step(at, "DISPATCH_TRIGGERED", 1)]

    assert dispatched(lifecycle.CLOSED_DAYS - 1) == []
    assert dispatched(lifecycle.CLOSED_DAYS) == ["DISPATCH_TRIGGERED"]


def test_consecutive_expiries_are_one_row():
    life = lifecycle.Life()
    rows = life.step(0, "DISPATCH_TRIGGERED", 5000) + life.advance(400 * lifecycle.RESPONSE)
    assert [(kind, attempt, offers) for kind, attempt, _, _, offers in rows] == [
        ("DISPATCH_TRIGGERED", 1, 1), ("TIMEOUT_EXPIRED", 1, 400),
    ]
    rows = life.advance(9000 * lifecycle.RESPONSE)
    assert [(kind, attempt, at // lifecycle.RESPONSE, offers) for kind, attempt, at, _, offers in rows] == [
        ("TIMEOUT_EXPIRED", 401, 401, 4599), ("CASCADE_EXHAUSTED", 5000, 5000, 1),
    ]


def test_orders_share_few_states_and_runs_are_stored(spark, monkeypatch):
    monkeypatch.setattr(lifecycle, "PAGES", 2)
    big = 2**60  # ids that a float would not keep
    rows = [(big + i, START + dt.timedelta(minutes=i), big + i, "DISPATCH_TRIGGERED", 30) for i in range(40)]
    rows.append((None, START, None, "DISPATCH_TRIGGERED", 3))
    rows.append((1, START + dt.timedelta(hours=30), 1, "LOCATION", 0))
    folder, out, checkpoint = (work_path(spark, n) for n in ("events", "life", "life-checkpoint"))
    log = spark.createDataFrame(rows, SCHEMA)
    log.coalesce(1).write.parquet(folder)
    query = lifecycle.start_lifecycle(spark.readStream.schema(SCHEMA).parquet(folder), out, checkpoint, "20 minutes")
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 2
    # a dispatch, a run of expiries and the end of the cascade
    assert lifecycle.read_runs(spark, out).count() == 3 * 41

    def found(df):
        return sorted(tuple(str(v) for v in r) for r in df.select("order_id", "event_type", "attempt", "at").collect())

    as_of = (START + dt.timedelta(hours=30) - dt.timedelta(minutes=20)).isoformat(sep=" ")
    want = found(lifecycle.replay(log.where("order_id is not null"), as_of))
    life = lifecycle.read_lifecycle(spark, out)
    assert len(want) == 40 * 31 and found(life.where("order_id is not null")) == want
    assert life.where("order_id is null").count() == 4


def test_positions_do_not_depend_on_batching(spark):
    rng = random.Random(4)
    schema = "rider_id bigint, ts timestamp, event_id bigint, lat double, lng double, address string, status string"
    rows = []
    for i in range(300):
        push = rng.random() < 0.6
        rows.append(
            (
                rng.randrange(0, 12),
                START + dt.timedelta(seconds=rng.randrange(0, 9000)),
                i,
                rng.random() if push else None,
                rng.random() if push else None,
                f"Stop {i}" if push and rng.random() < 0.5 else None,
                None if push else rng.choice(["Available", " Busy "]),
            )
        )
    whole = positions.reduce_events(spark.createDataFrame(rows, schema))
    want = sorted((r["rider_id"], tuple(r["position"] or ()), r["address"], r["status"]) for r in whole.collect())
    folder, path, checkpoint = (work_path(spark, n) for n in ("pushes", "snapshot", "snapshot-checkpoint"))
    last = None
    for i in range(3):
        spark.createDataFrame(rows[i::3], schema).coalesce(1).write.mode("append").parquet(folder)
        query = positions.start_positions(spark.readStream.schema(schema).parquet(folder), path, checkpoint)
        query.awaitTermination()
        last = i
    snapshot = positions.latest_snapshot(spark, path, last)
    got = sorted((r["rider_id"], tuple(r["position"] or ()), r["address"], r["status"]) for r in snapshot.collect())
    assert got == want
    assert len(os.listdir(path)) == 3
