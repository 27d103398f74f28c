"""Courier ranking and assignment.

Effective distance is the distance to the hotel shortened by performance and
rating; the nearest available courier wins, ties going to the lowest id. Pending
offers reserve nobody, so every order is assigned on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from courierflow import domain as D
from courierflow.functions.geo import haversine_km
from courierflow.functions.scalars import or_default

# Bonus weights and the stand-ins for missing scores.
PERFORMANCE_WEIGHT = 0.25
RATING_WEIGHT = 0.15
DEFAULT_PERFORMANCE = 100.0
DEFAULT_RATING = 4.8

RANK_CELL_KM = 0.25
RANK_ID_SPAN = 65536


def available_couriers(riders: DataFrame, hotels: DataFrame) -> DataFrame:
    """Available riders with their distance and effective distance to their hotel.

    A missing or zero coordinate counts as being at the hotel. A hotel without
    coordinates, or one that is not in ``hotels``, stands at the default origin.
    """
    placed = F.coalesce((F.col("latitude") != 0) | (F.col("longitude") != 0), F.lit(False))
    origin = hotels.where(placed & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    near = (
        riders.where(F.lower("status") == "available")
        .join(origin.select("hotel_id", "latitude", "longitude"), "hotel_id", "left")
        .fillna({"latitude": D.DEFAULT_LAT, "longitude": D.DEFAULT_LNG})
    )
    lat = F.coalesce(F.nullif(F.col("current_lat"), F.lit(0.0)), F.col("latitude"))
    lng = F.coalesce(F.nullif(F.col("current_lng"), F.lit(0.0)), F.col("longitude"))
    km = F.round(haversine_km(F.col("latitude"), F.col("longitude"), lat, lng), 2)
    bonus = (
        or_default(F.col("performance_score"), DEFAULT_PERFORMANCE) / 100.0 * PERFORMANCE_WEIGHT
        + or_default(F.col("rating"), DEFAULT_RATING) / 5.0 * RATING_WEIGHT
    )
    return (
        near.withColumn("distance_to_hotel_km", km)
        .withColumn("effective_km", F.col("distance_to_hotel_km") / (F.lit(1.0) + bonus))
        .drop("latitude", "longitude")
    )


def nearest_courier(couriers: DataFrame) -> DataFrame:
    """Best courier of each hotel as the struct ``rider``.

    An aggregate, so each task keeps one candidate per hotel before the shuffle
    and no hotel's fleet is sorted or collected.
    """
    rider = F.struct(
        F.col("id").alias("rider_id"),
        "rider_name",
        "vehicle_type",
        "courier_exp_yrs",
        "distance_to_hotel_km",
        "effective_km",
    )
    return couriers.groupBy("hotel_id").agg(
        F.min_by(rider, F.struct("effective_km", "id")).alias("rider")
    )


def assign_nearest(orders: DataFrame, couriers: DataFrame) -> DataFrame:
    """Orders with their hotel's best courier; null where the hotel has none available."""
    return orders.join(nearest_courier(couriers), "hotel_id", "left")


def top_couriers(couriers: DataFrame, depth: int) -> DataFrame:
    """The ``depth`` best couriers of each hotel, ranked.

    The rank limit is a literal, so Spark drops deeper rows before the shuffle.
    """
    best_first = Window.partitionBy("hotel_id").orderBy("effective_km", "id")
    return couriers.withColumn("rank", F.row_number().over(best_first)).where(
        F.col("rank") <= depth
    )


def rank_couriers(couriers: DataFrame) -> DataFrame:
    """Complete ranking of each hotel's couriers.

    Couriers fall into cells of effective distance (those at the hotel itself
    into spans of ids). Cells are counted, the counts summed up in order, and
    only couriers of one cell are sorted together, so a fleet of any size is
    ranked by many tasks.
    """
    at_hotel = F.col("effective_km") == 0
    placed = couriers.withColumns(
        {
            "_cell": F.when(at_hotel, F.lit(-1)).otherwise(
                F.floor(F.col("effective_km") / RANK_CELL_KM)
            ),
            "_span": F.when(at_hotel, F.floor(F.col("id") / RANK_ID_SPAN)).otherwise(F.lit(0)),
        }
    )
    cell_keys = ["hotel_id", "_cell", "_span"]
    before = (
        Window.partitionBy("hotel_id")
        .orderBy("_cell", "_span")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        placed.groupBy(*cell_keys)
        .agg(F.count("*").alias("_rows"))
        .select(*cell_keys, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy(*cell_keys).orderBy("effective_km", "id")
    return (
        placed.withColumn("_position", F.row_number().over(within))
        .join(offsets, cell_keys)
        .withColumn("rank", F.col("_offset") + F.col("_position"))
        .drop("_cell", "_span", "_position", "_offset")
    )


def next_courier(orders: DataFrame, couriers: DataFrame) -> DataFrame:
    """Best courier not yet notified, per order, as the struct ``next_rider``.

    Told couriers are looked up in the ranking by (hotel, courier); the smallest
    rank among them that is missing is the next one, joined by (hotel, rank). No
    list is longer than the order's own, and orders are never multiplied with
    couriers. Told couriers who are not available have no rank and are passed over.
    """
    member = F.struct(
        F.col("rank").cast("int").alias("rank"), F.col("id").alias("rider_id"), "rider_name", "vehicle_type", "courier_exp_yrs"
    )
    ranked = rank_couriers(couriers).select("hotel_id", "rank", "id", member.alias("next_rider"))
    told = F.coalesce(F.sort_array(F.array_distinct("notified_rider_ids")), F.array().cast("array<bigint>"))
    asked = orders.withColumn("_told", told)
    # sorted ranks equal their places up to the first one that is missing
    ranks = F.sort_array(F.collect_set("rank"))
    unbroken = F.size(F.filter(ranks, lambda r, i: r == i + 1))
    nexts = (
        asked.select("hotel_id", "_told").distinct()
        .select("hotel_id", "_told", F.explode("_told").alias("id"))
        .join(ranked.select("hotel_id", "id", "rank"), ["hotel_id", "id"])
        .groupBy("hotel_id", "_told")
        .agg((unbroken + 1).cast("bigint").alias("_next"))
    )
    picks = ranked.select("hotel_id", F.col("rank").cast("bigint").alias("_next"), "next_rider")
    return (
        asked.join(nexts, ["hotel_id", "_told"], "left")
        .withColumn("_next", F.coalesce("_next", F.lit(1).cast("bigint")))
        .join(picks, ["hotel_id", "_next"], "left")
        .select(*orders.columns, "next_rider")
    )
