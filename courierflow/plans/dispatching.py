"""Dispatch creation: enrich orders, pick couriers, estimate, and open the offers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierflow import domain as D
from courierflow.functions import geo
from courierflow.functions.rounding import np_round
from courierflow.functions.scalars import blank_to_null, or_default, time_of_day, tracking_id
from courierflow.operators.assignment import assign_nearest
from courierflow.operators.dispatch import response_deadline
from courierflow.operators.matching import with_hotel_defaults, with_weather_in_force
from courierflow.operators.quality import violation_codes
from courierflow.plans.regression import fallback_minutes

# What an order gets where nothing better is known.
DEFAULT_TRAFFIC = "Medium"
DEFAULT_EXPERIENCE = 2.5
CLIENT_NAME = "Valued Customer"
CLIENT_PHONE = "N/A"


def enrich(
    requests: DataFrame, hotels: DataFrame, couriers: DataFrame, observations: DataFrame
) -> DataFrame:
    """Requests with drop-off, distance, weather, time of day, courier and the features.

    ``requests`` has order_id, hotel_id, created_at, and nullable tracking_id,
    dest_lat, dest_lng, vehicle_type, prep_time_min and traffic_level.
    """
    located = with_hotel_defaults(requests, hotels)
    origin = F.col("hotel_lat"), F.col("hotel_lng")
    dest_lat, dest_lng = geo.drop_off_or_synthetic(*origin, F.col("dest_lat"), F.col("dest_lng"))
    placed = located.withColumns({"dest_lat": dest_lat, "dest_lng": dest_lng})
    observed = with_weather_in_force(placed, observations, "created_at")
    offered = assign_nearest(observed, couriers)
    rider = F.col("rider")
    given_tracking = blank_to_null(F.col("tracking_id"))
    return offered.withColumns(
        {
            "tracking_id": F.coalesce(given_tracking, tracking_id(F.col("order_id"))),
            "distance_km": geo.delivery_km(*origin, F.col("dest_lat"), F.col("dest_lng")),
            "weather": F.col("weather_now"),
            "traffic_level": F.coalesce(blank_to_null(F.col("traffic_level")), F.lit(DEFAULT_TRAFFIC)),
            "time_of_day": time_of_day(F.col("created_at")),
            "vehicle_type": F.coalesce(
                blank_to_null(rider["vehicle_type"]),
                blank_to_null(F.col("vehicle_type")),
                "hotel_vehicle",
            ),
            "preparation_time_min": F.coalesce("prep_time_min", "hotel_prep_min"),
            "courier_experience_yrs": or_default(rider["courier_exp_yrs"], DEFAULT_EXPERIENCE),
            "assigned_rider_id": rider["rider_id"],
            "rider_name": rider["rider_name"],
        }
    ).drop("weather_now", "obs_id", "prep_time_min", "hotel_prep_min", "hotel_vehicle", "rider")


def estimate_with(model: PipelineModel) -> Callable[[DataFrame], DataFrame]:
    """ETA by a fitted pipeline; orders outside the accepted ranges get the fallback."""

    def estimate(df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns]
        judged = df.withColumn("_broken", F.size(violation_codes()))
        scored = model.transform(judged.where("_broken = 0")).select(
            *kept, np_round(F.col("prediction"), 2).alias("predicted_eta_min")
        )
        other = judged.where("_broken > 0").select(
            *kept, fallback_minutes(F.col("distance_km")).alias("predicted_eta_min")
        )
        return scored.unionByName(other)

    return estimate


def estimate_fallback(df: DataFrame) -> DataFrame:
    """ETA by the distance formula alone."""
    return df.withColumn("predicted_eta_min", fallback_minutes(F.col("distance_km")))


def create_dispatches(
    requests: DataFrame,
    hotels: DataFrame,
    couriers: DataFrame,
    observations: DataFrame,
    estimate: Callable[[DataFrame], DataFrame] = estimate_fallback,
) -> DataFrame:
    """New dispatch orders: pending with a five-minute offer, or unassigned."""
    enriched = estimate(enrich(requests, hotels, couriers, observations))
    assigned = F.col("assigned_rider_id").isNotNull()
    payload = F.to_json(
        F.struct(
            "tracking_id",
            "hotel_name",
            "hotel_lat",
            "hotel_lng",
            "dest_lat",
            "dest_lng",
            *D.RAW_FEATURES,
            "predicted_eta_min",
            "assigned_rider_id",
        )
    )
    return enriched.withColumns(
        {
            "dispatch_status": F.when(assigned, D.PENDING).otherwise(D.UNASSIGNED),
            "dispatch_attempts": F.lit(1),
            "notified_rider_ids": F.array().cast("array<bigint>"),
            "token_expires_at": response_deadline(F.col("created_at")),
            "raw_payload": payload,
        }
    )
