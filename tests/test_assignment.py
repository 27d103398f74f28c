from __future__ import annotations

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from courierflow import domain as D
from courierflow.catalog.lookups import couriers, notified_orders
from courierflow.operators import assignment, dispatch, matching, ratings, splitting


def test_ranking_by_pieces_equals_one_sort(tables):
    pool = couriers(tables)
    got = {(r["hotel_id"], r["id"]): r["rank"] for r in assignment.rank_couriers(pool).collect()}
    rows = pool.select("hotel_id", "id", "effective_km").toPandas()
    rows = rows.sort_values(["hotel_id", "effective_km", "id"])
    rows["rank"] = rows.groupby("hotel_id").cumcount() + 1
    assert got == {(h, i): r for h, i, r in zip(rows["hotel_id"], rows["id"], rows["rank"])}


def test_large_fleet_ranks_across_pieces(spark):
    fleet = spark.range(0, 200_000, numPartitions=8).select(
        F.lit(1).alias("hotel_id"),
        "id",
        F.when(F.col("id") % 3 == 0, 0.0).otherwise((F.col("id") * 7919 % 5000) / 100).alias("effective_km"),
    )
    ranked = assignment.rank_couriers(fleet).select("id", "effective_km", "rank").toPandas()
    ranked = ranked.sort_values(["effective_km", "id"]).reset_index(drop=True)
    assert (ranked["rank"] == ranked.index + 1).all()


def test_effective_distance_never_exceeds_distance(tables):
    assert couriers(tables).where("effective_km > distance_to_hotel_km").count() == 0


def test_next_courier_is_never_a_notified_one(tables):
    picked = assignment.next_courier(notified_orders(tables), couriers(tables))
    wrong = picked.where(F.array_contains("notified_rider_ids", F.col("next_rider.rider_id")))
    assert wrong.count() == 0
    home = picked.where("next_rider is not null").select("hotel_id", F.col("next_rider.rider_id").alias("id"))
    pool = couriers(tables).select("hotel_id", "id")
    assert home.join(pool, ["hotel_id", "id"], "left_anti").count() == 0


def test_cascade_keeps_attempts_and_list_in_step(spark):
    riders = spark.createDataFrame(
        [(i, 1, f"R{i}", "Bike", 1.0, float(i)) for i in range(1, 5)],
        "id bigint, hotel_id bigint, rider_name string, vehicle_type string, courier_exp_yrs double, effective_km double",
    )
    orders = spark.createDataFrame(
        [
            (10, 1, 1, [], 1, D.PENDING),
            (11, 1, 2, [1], 2, D.PENDING),
            (12, 1, 4, [1, 2, 3], 4, D.PENDING),
            (13, 1, 1, [], 1, D.ACTIVE),
            (14, 1, 1, [], 1, D.DELIVERED),
            (15, 2, 9, [], 1, D.PENDING),
        ],
        "order_id bigint, hotel_id bigint, assigned_rider_id bigint, notified_rider_ids array<bigint>, "
        "dispatch_attempts int, dispatch_status string",
    ).withColumn("token_expires_at", F.lit("2024-01-01 10:05:00").cast("timestamp"))
    moved = dispatch.cascade(orders, riders, "2024-01-01 10:05:00", dispatch.DECLINED)
    rows = {r["order_id"]: r for r in moved.collect()}
    assert (rows[10]["assigned_rider_id"], rows[10]["dispatch_attempts"]) == (2, 2)
    assert (rows[11]["assigned_rider_id"], rows[11]["notified_rider_ids"]) == (3, [1, 2])
    assert rows[12]["dispatch_status"] == D.UNASSIGNED
    assert rows[12]["event_type"] == "CASCADE_EXHAUSTED"
    assert rows[13]["dispatch_status"] == D.ACTIVE and rows[13]["event_type"] is None
    assert rows[14]["dispatch_status"] == D.DELIVERED and rows[14]["event_type"] is None
    assert rows[15]["dispatch_status"] == D.UNASSIGNED
    for r in rows.values():
        if r["dispatch_status"] == D.PENDING:
            assert r["dispatch_attempts"] == len(r["notified_rider_ids"]) + 1
            assert r["event_type"] == "ORDER_DEACTIVATED"


def test_expiry_at_the_same_moment_counts_as_expired(spark):
    orders = spark.createDataFrame(
        [(1, D.PENDING, "2024-01-01 10:05:00")], "order_id bigint, dispatch_status string, e string"
    ).withColumn("token_expires_at", F.col("e").cast("timestamp"))
    assert dispatch.timed_out(orders, "2024-01-01 10:05:00").count() == 1
    assert dispatch.timed_out(orders, "2024-01-01 10:04:59").count() == 0


def test_last_value_in_force_equals_brute_force(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)

    def moments(n, hot):
        rows = []
        for i in range(n):
            key = 1 if rng.random() < hot else rng.randrange(2, 6)
            rows.append((i, key, start + dt.timedelta(minutes=rng.randrange(0, 20 * 24 * 60))))
        return rows

    seen, asked = moments(400, 0.4), moments(600, 0.4)
    obs = spark.createDataFrame([(k, t, i) for i, k, t in seen], "k bigint, at timestamp, v bigint")
    obs = obs.groupBy("k", "at").agg(F.max("v").alias("v"))
    probes = spark.createDataFrame([(i, k, t) for i, k, t in asked], "i bigint, k bigint, t timestamp")
    got = matching.latest_before(probes, obs, "k", "t", "at", "v")
    got = {(r["k"], r["t"]): r["v"] for r in got.collect()}
    left = pd.DataFrame(asked, columns=["i", "k", "t"]).sort_values("t")
    right = pd.DataFrame(seen, columns=["v", "k", "at"]).sort_values(["at", "v"])
    want = pd.merge_asof(left, right, left_on="t", right_on="at", by="k")
    assert len(got) == len(left.drop_duplicates(["k", "t"]))
    for k, t, v in zip(want["k"], want["t"], want["v"]):
        assert got[(k, t.to_pydatetime())] == (None if pd.isna(v) else v)


def test_ratings_of_a_hot_rider_equal_the_sequential_fold(spark):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    base = {1: 4.6, 2: 4.9, 3: 4.75, 4: 3.05, 5: 0.0, 6: 2.1, 7: 1.0}
    rows = []
    for i in range(6000):
        rider = 1 if rng.random() < 0.5 else rng.choice([2, 3, 4, 5, 6])
        rows.append((rider, start + dt.timedelta(seconds=rng.randrange(0, 40000)), i, int(rng.random() < 0.6)))
    done = spark.createDataFrame(rows, "rider_id bigint, ts timestamp, id bigint, was_on_time int").repartition(8)
    riders = spark.createDataFrame(list(base.items()), "id bigint, rating double")
    got = {r["id"]: r["rating"] for r in ratings.updated_ratings(riders, done).collect()}
    for rider, rating in base.items():
        mine = sorted((t, i, f) for r, t, i, f in rows if r == rider)
        state = (rating or 4.8) if mine else rating
        for _, _, on_time in mine:
            state = min(5.0, round(state + (0.05 if on_time else -0.05), 1))
        assert got[rider] == state
    runs = ratings.rating_runs(done).groupBy("rider_id").count().where("rider_id = 1").first()[0]
    assert runs >= 1


def test_rating_example(spark):
    done = spark.createDataFrame(
        [(1, i, f) for i, f in enumerate([1, 1, 0, 1])], "rider_id bigint, id bigint, was_on_time int"
    ).withColumn("ts", F.timestamp_seconds("id"))
    riders = spark.createDataFrame([(1, 4.6)], "id bigint, rating double")
    assert ratings.updated_ratings(riders, done).first()["rating"] == 4.5


def test_exact_split_sizes_with_a_hot_group(spark):
    df = spark.range(0, 30_000, numPartitions=6).select(
        F.col("id").alias("order_id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).cast("bigint").alias("g"),
    )
    split = splitting.with_exact_split(df, "order_id", F.ceil(F.col("n") * 0.2), ["g"])
    counts = split.groupBy("g").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t"))
    assert split.count() == 30_000
    assert counts.where(F.col("t") != F.ceil(F.col("n") * 0.2)).count() == 0
    whole = splitting.with_exact_split(df, "order_id", F.lit(777))
    assert whole.where("split = 'test'").count() == 777
    assert whole.count() == 30_000


def test_folds_partition_the_rows(tables):
    folds = splitting.with_fold(tables.deliveries.select("order_id")).groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in folds) == [0, 1, 2, 3, 4]
    assert sum(r["count"] for r in folds) == tables.deliveries.count()


def test_hotels_without_position_stand_at_the_default_origin(spark):
    from courierflow import domain as D
    from courierflow.operators.assignment import available_couriers

    hotels = spark.createDataFrame([(1, None, None), (2, 0.0, 0.0)], "hotel_id long, latitude double, longitude double")
    riders = spark.createDataFrame(
        [(h, 10 * h + k, "Available", lat, lng, 4.0, 90.0) for h in (1, 2, 3) for k, lat, lng in ((0, D.DEFAULT_LAT + 1, D.DEFAULT_LNG), (1, D.DEFAULT_LAT, D.DEFAULT_LNG))],
        "hotel_id long, id long, status string, current_lat double, current_lng double, rating double, performance_score double",
    )
    km = {r["id"]: r["distance_to_hotel_km"] for r in available_couriers(riders, hotels).collect()}
    assert len(km) == 6
    assert all(km[10 * h + 1] == 0.0 and 100 < km[10 * h] < 125 for h in (1, 2, 3))
