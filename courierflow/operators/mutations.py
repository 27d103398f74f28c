"""Snapshot changes: upserts, deletes, last-write-wins positions, and the prediction log.

A changed table is a new DataFrame made from the old one and a batch of changes;
changes are reduced to one row per key before they meet the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierflow.functions.rounding import py_round
from courierflow.functions.scalars import blank_to_null, delay_risk, hash_position


def merge_snapshot(
    current: DataFrame,
    changes: DataFrame,
    key: str,
    sequence: str,
    keep_if_blank: tuple[str, ...] = (),
) -> DataFrame:
    """``current`` after upserts and deletes; of a key's changes the last one counts.

    ``changes`` has the columns of ``current``, a ``deleted`` flag and the
    sequence. Columns in ``keep_if_blank`` keep their last non-blank value.
    """
    columns = [c for c in current.columns if c != key]
    replaced = [c for c in columns if c not in keep_if_blank]
    latest = F.max_by(F.struct("deleted", *replaced), F.col(sequence)).alias("_new")
    kept = [
        F.max_by(c, F.when(blank_to_null(F.col(c)).isNotNull(), F.col(sequence))).alias(f"_keep_{c}")
        for c in keep_if_blank
    ]
    reduced = changes.groupBy(key).agg(latest, *kept)
    merged = current.join(reduced, key, "full")
    changed = F.col("_new").isNotNull()
    values = {c: F.when(changed, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in replaced}
    values.update({c: F.coalesce(f"_keep_{c}", c) for c in keep_if_blank})
    remaining = merged.where(~F.coalesce(F.col("_new.deleted"), F.lit(False)))
    return remaining.select(key, *[values[c].alias(c) for c in columns])


def resolve_profile_ids(
    changes: DataFrame, current: DataFrame, match_latest: bool = False
) -> DataFrame:
    """Target id of each profile change: its own id, else by email, else the newest profile.

    Without ``match_latest`` an unmatched change is a new profile and gets an id
    from the hash of its email and name.
    """
    email = F.lower(F.trim(F.col("contact_email")))
    by_email = current.groupBy(email.alias("_email")).agg(F.min("id").alias("_by_email"))
    joined = changes.withColumn("_email", F.nullif(email, F.lit(""))).join(by_email, "_email", "left")
    if match_latest:
        newest = F.max_by("id", F.struct("updated_at", "id"))
        other = current.agg(newest).scalar()
    else:
        other = hash_position(F.concat_ws("|", "contact_email", "hotel_name"), "profile")
    return joined.withColumn("id", F.coalesce("id", "_by_email", other)).drop("_email", "_by_email")


def latest_positions(riders: DataFrame, events: DataFrame) -> DataFrame:
    """Riders after position and status events; the last of each kind wins.

    ``events`` has rider_id, ts, event_id, lat, lng, address and status; a null
    address or status leaves the earlier one.
    """
    moment = F.struct("ts", "event_id")

    def last_given(value: Column, given: str) -> Column:
        return F.max_by(value, F.when(F.col(given).isNotNull(), moment))

    reduced = events.groupBy(F.col("rider_id").alias("id")).agg(
        last_given(F.struct("lat", "lng"), "lat").alias("_at"),
        last_given(F.col("address"), "address").alias("_address"),
        last_given(F.trim("status"), "status").alias("_status"),
        F.max("ts").alias("last_active_at"),
    )
    return (
        riders.join(reduced, "id", "left")
        .withColumns(
            {
                "current_lat": F.coalesce("_at.lat", "current_lat"),
                "current_lng": F.coalesce("_at.lng", "current_lng"),
                "current_address": F.coalesce("_address", "current_address"),
                "status": F.coalesce("_status", "status"),
            }
        )
        .drop("_at", "_address", "_status")
    )


def prediction_log(scored: DataFrame, predicted: str, source_type: str, default_hotel: int = 1) -> DataFrame:
    """Rows to append to the prediction history, with risk and hotel filled in."""
    minutes = F.col(predicted)
    given_risk = F.col("risk_status") if "risk_status" in scored.columns else F.lit(None)
    return scored.select(
        F.coalesce("hotel_id", F.lit(default_hotel).cast("bigint")).alias("hotel_id"),
        "order_reference",
        "distance_km",
        F.coalesce("weather", F.lit("Clear")).alias("weather"),
        F.coalesce("traffic_level", F.lit("Medium")).alias("traffic_level"),
        F.coalesce("time_of_day", F.lit("Evening")).alias("time_of_day"),
        F.coalesce("vehicle_type", F.lit("Scooter")).alias("vehicle_type"),
        F.coalesce("preparation_time_min", F.lit(15.0)).alias("prep_time_min"),
        F.coalesce("courier_experience_yrs", F.lit(3.0)).alias("courier_exp_yrs"),
        py_round(minutes, 2).alias("predicted_time_min"),
        F.coalesce(F.nullif(given_risk, F.lit("")), delay_risk(minutes)).alias("risk_status"),
        F.lit(source_type).alias("source_type"),
    )


def clear_history(history: DataFrame, hotel_id: int) -> DataFrame:
    """History without one hotel's rows; on a table partitioned by hotel, a pruned read."""
    return history.where(F.col("hotel_id") != hotel_id)
