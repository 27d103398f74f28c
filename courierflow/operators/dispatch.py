"""Dispatch transitions as set operations: expire, cascade, activate, complete, log, notify.

The current time is always a parameter. An offer whose expiry equals the current
time counts as expired everywhere, and a delivered order is final.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierflow import domain as D
from courierflow.functions.rounding import py_round
from courierflow.functions.scalars import contact_email
from courierflow.operators.assignment import next_courier

DECLINED = "rider_declined"
TIMED_OUT = "5_minute_timeout"

# Notification subject and the state of a message that is only logged.
SUBJECT = "\U0001f4e6 URGENT Delivery Mission: %s [%s km • ~%s min]"
LOGGED_ONLY = "SIMULATED"


def as_timestamp(as_of: str | Column) -> Column:
    return F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of


def response_deadline(offered_at: Column) -> Column:
    return offered_at + F.make_dt_interval(mins=F.lit(D.RESPONSE_MINUTES))


def timed_out(orders: DataFrame, as_of: str | Column) -> DataFrame:
    """Pending orders whose offer has expired by ``as_of``."""
    return orders.where(
        (F.col("dispatch_status") == D.PENDING)
        & F.col("token_expires_at").isNotNull()
        & (F.col("token_expires_at") <= as_timestamp(as_of))
    )


def countdown(orders: DataFrame, as_of: str | Column) -> DataFrame:
    """Whole seconds left of every pending offer, and whether it has expired."""
    left = (
        F.unix_micros("token_expires_at") - F.unix_micros(as_timestamp(as_of))
    ).cast("double") / 1e6
    seconds = F.greatest(F.lit(0), F.floor(left)).cast("bigint")
    # printf-style padding widens but never cuts long waits.
    clock = F.format_string("%02d:%02d", F.floor(seconds / 60), seconds % 60)
    return orders.where(F.col("dispatch_status") == D.PENDING).withColumns(
        {
            "seconds_left": seconds,
            "expired": left <= 0,
            "shown": F.when(left <= 0, "00:00 (EXPIRED)").otherwise(clock),
        }
    )


def cascade(orders: DataFrame, couriers: DataFrame, as_of: str | Column, reason: str) -> DataFrame:
    """Offer every given order to its hotel's next courier, or mark it unassigned.

    ``orders`` has order_id, hotel_id, assigned_rider_id, notified_rider_ids,
    dispatch_attempts and dispatch_status. Active and delivered orders stay as
    they are, with no event.
    """
    open_order = ~F.col("dispatch_status").isin(D.ACTIVE, D.DELIVERED)
    told = F.coalesce("notified_rider_ids", F.array().cast("array<bigint>"))
    dropped = F.col("assigned_rider_id")
    # The dropped courier joins the end of the list unless already on it.
    told = F.when(
        dropped.isNotNull() & ~F.array_contains(told, F.coalesce(dropped, F.lit(-1))),
        F.array_append(told, dropped),
    ).otherwise(told)
    movable = orders.withColumn(
        "notified_rider_ids", F.when(open_order, told).otherwise(F.col("notified_rider_ids"))
    )
    offered = next_courier(movable, couriers)
    found = F.col("next_rider").isNotNull()
    now = as_timestamp(as_of)
    fallback = "ORDER_DEACTIVATED" if reason == DECLINED else "TIMEOUT_EXPIRED"
    return offered.withColumns(
        {
            "event_type": F.when(
                open_order, F.when(found, fallback).otherwise("CASCADE_EXHAUSTED")
            ),
            "dropped_rider_id": F.when(open_order, dropped),
            "assigned_rider_id": F.when(open_order & found, F.col("next_rider.rider_id")).otherwise(dropped),
            "dispatch_attempts": F.col("dispatch_attempts") + (open_order & found).cast("int"),
            "token_expires_at": F.when(open_order & found, response_deadline(now)).otherwise(
                F.col("token_expires_at")
            ),
            "updated_at": F.when(open_order, now),
            "dispatch_status": F.when(
                open_order, F.when(found, D.PENDING).otherwise(D.UNASSIGNED)
            ).otherwise(F.col("dispatch_status")),
        }
    ).drop("next_rider")


def activation_outcomes(orders: DataFrame, requests: DataFrame) -> DataFrame:
    """What each activation request (order_id, event_id, ts) does to its order.

    The first request in time decides; the order's later requests find it
    active. The first one is found by an aggregate, not by sorting an order's
    requests.
    """
    first = requests.groupBy("order_id").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    known = orders.select("order_id", "dispatch_status", "token_expires_at", "assigned_rider_id")
    judged = known.join(first, "order_id").join(requests, "order_id")
    status = F.col("dispatch_status")
    open_order = status.isNull() | (status == D.PENDING)
    in_time = F.col("token_expires_at").isNull() | (F.col("first.ts") < F.col("token_expires_at"))
    is_first = F.col("event_id") == F.col("first.event_id")
    outcome = (
        F.when(status == D.ACTIVE, "already_active")
        .when(~open_order, F.concat(F.lit("already_"), F.lower(status)))
        .when(~in_time, F.when(is_first, "expired").otherwise("invalid_token"))
        .when(is_first, "activated")
        .otherwise("already_active")
    )
    return judged.select("order_id", "event_id", "ts", "assigned_rider_id", outcome.alias("outcome"))


def cascade_expired(orders: DataFrame, outcomes: DataFrame, couriers: DataFrame) -> DataFrame:
    """Orders whose first click came too late, offered on at the time of that click."""
    late = outcomes.where("outcome = 'expired'").select("order_id", F.col("ts").alias("clicked_at"))
    return cascade(orders.join(late, "order_id"), couriers, F.col("clicked_at"), TIMED_OUT)


def apply_activations(orders: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Orders after their activations; at most one request per order activates."""
    activated = outcomes.where("outcome = 'activated'").select(
        "order_id", F.col("ts").alias("activated_at")
    )
    return orders.join(activated, "order_id", "left").withColumn(
        "dispatch_status",
        F.when(F.col("activated_at").isNotNull(), D.ACTIVE).otherwise(F.col("dispatch_status")),
    )


def rider_status_changes(outcomes: DataFrame, completed: DataFrame) -> DataFrame:
    """Status rows for riders: on delivery after activation, available after completion."""
    busy = outcomes.where("outcome = 'activated' and assigned_rider_id is not null").select(
        F.col("assigned_rider_id").alias("rider_id"), "ts", F.lit("On Delivery").alias("status")
    )
    free = completed.where("assigned_rider_id is not null").select(
        F.col("assigned_rider_id").alias("rider_id"),
        F.col("completed_at").alias("ts"),
        F.lit("Available").alias("status"),
    )
    return busy.unionByName(free)


def complete(orders: DataFrame, completions: DataFrame) -> DataFrame:
    """Delivered orders with duration and punctuality.

    ``completions`` has order_id, completed_at and given_duration_min (may be
    null); the duration otherwise runs from activation, else from creation.
    """
    started = F.coalesce("activated_at", "created_at")
    elapsed = (F.unix_micros("completed_at") - F.unix_micros(started)).cast("double") / 6e7
    measured = F.greatest(F.lit(1.0), py_round(elapsed, 1))
    duration = F.coalesce("given_duration_min", measured, "predicted_eta_min")
    on_time = duration <= F.col("predicted_eta_min") + D.ON_TIME_GRACE_MIN
    return (
        orders.join(completions, "order_id")
        .withColumns(
            {
                "dispatch_status": F.lit(D.DELIVERED),
                "actual_duration_min": duration,
                "was_on_time": on_time.cast("int"),
            }
        )
        .drop("given_duration_min")
    )


def completion_history(completed: DataFrame) -> DataFrame:
    """History rows of completed dispatches; their risk tells punctuality, not a threshold."""
    on_time = F.col("was_on_time") == 1
    return completed.select(
        "hotel_id",
        F.col("tracking_id").alias("order_reference"),
        "distance_km",
        "weather",
        "traffic_level",
        "time_of_day",
        "vehicle_type",
        "prep_time_min",
        "courier_exp_yrs",
        F.col("predicted_eta_min").alias("predicted_time_min"),
        F.when(on_time, D.RISK_FAST).otherwise(D.RISK_HIGH).alias("risk_status"),
        F.lit("dispatch_delivery").alias("source_type"),
        F.col("completed_at").alias("created_at"),
    )


def _event(df: DataFrame, kind: str | Column, rider: str, at: str, details: Column) -> DataFrame:
    return df.select(
        "order_id",
        "tracking_id",
        F.col(rider).alias("rider_id"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("event_type"),
        F.to_json(details).alias("details"),
        F.col(at).alias("created_at"),
    )


def created_events(orders: DataFrame) -> DataFrame:
    return _event(
        orders,
        "DISPATCH_TRIGGERED",
        "assigned_rider_id",
        "created_at",
        F.struct(F.coalesce("rider_name", F.lit("")).alias("assigned_rider")),
    )


def cascade_events(cascaded: DataFrame, reason: str) -> DataFrame:
    exhausted = F.col("event_type") == "CASCADE_EXHAUSTED"
    details = F.struct(
        F.when(exhausted, "All couriers notified or unavailable").alias("message"),
        F.when(~exhausted, F.col("dropped_rider_id")).alias("dropped_rider"),
        F.when(~exhausted, F.col("assigned_rider_id")).alias("cascaded_to"),
        F.lit(reason).alias("reason"),
    )
    moved = cascaded.where("event_type is not null")
    return _event(moved, F.col("event_type"), "dropped_rider_id", "updated_at", details)


def activated_events(orders: DataFrame) -> DataFrame:
    details = F.struct(
        F.date_format("activated_at", "yyyy-MM-dd HH:mm:ss").alias("activated_at")
    )
    active = orders.where("activated_at is not null")
    return _event(active, "ORDER_ACTIVATED", "assigned_rider_id", "activated_at", details)


def completed_events(completed: DataFrame) -> DataFrame:
    details = F.struct(
        "actual_duration_min",
        "predicted_eta_min",
        (F.col("was_on_time") == 1).alias("was_on_time"),
    )
    return _event(completed, "ORDER_COMPLETED", "assigned_rider_id", "completed_at", details)


def notifications(orders: DataFrame) -> DataFrame:
    """Log rows of the offers sent to couriers: recipient and subject; nothing is sent."""
    subject = F.format_string(
        SUBJECT,
        F.col("tracking_id"),
        F.col("distance_km").cast("string"),
        F.col("predicted_eta_min").cast("string"),
    )
    return orders.where("assigned_rider_id is not null").select(
        "tracking_id",
        F.col("assigned_rider_id").alias("rider_id"),
        contact_email(F.col("rider_email"), F.col("rider_name")).alias("recipient_email"),
        subject.alias("subject"),
        F.lit(LOGGED_ONLY).alias("status"),
        F.col("created_at").alias("sent_at"),
    )
