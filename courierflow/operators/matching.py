"""Lookup joins: profiles, audit trails, weather in force, model choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from courierflow import domain as D
from courierflow.functions.scalars import or_default, weather_class

# What an order gets where its hotel is unknown or incomplete.
HOTEL_NAME = "Express Hub"
HOTEL_ADDRESS = "Dispatch Origin"
HOTEL_PREP_MIN = 15.0
HOTEL_VEHICLE = "Scooter"


def with_hotel_defaults(orders: DataFrame, hotels: DataFrame) -> DataFrame:
    """Orders with their hotel's name, address, origin and defaults, or the constants."""
    present = {c.lower() for c in hotels.columns}
    address = F.col("branch_or_address") if "branch_or_address" in present else F.lit(None)
    profile = hotels.select(
        "hotel_id",
        F.col("hotel_name").alias("_name"),
        address.cast("string").alias("_address"),
        F.col("latitude").alias("_lat"),
        F.col("longitude").alias("_lng"),
        F.col("default_prep_time_min").alias("_prep"),
        F.col("default_vehicle_type").alias("_vehicle"),
    )

    def text(c: str, default: str):
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))

    return (
        orders.join(profile, "hotel_id", "left")
        .withColumns(
            {
                "hotel_name": text("_name", HOTEL_NAME),
                "hotel_address": text("_address", HOTEL_ADDRESS),
                "hotel_lat": or_default(F.col("_lat"), D.DEFAULT_LAT),
                "hotel_lng": or_default(F.col("_lng"), D.DEFAULT_LNG),
                "hotel_prep_min": or_default(F.col("_prep"), HOTEL_PREP_MIN),
                "hotel_vehicle": text("_vehicle", HOTEL_VEHICLE),
            }
        )
        .drop("_name", "_address", "_lat", "_lng", "_prep", "_vehicle")
    )


def with_audit_trail(orders: DataFrame, log: DataFrame) -> DataFrame:
    """One row per order and log entry, in no order; an order without entries has nulls."""
    return orders.join(log, "tracking_id", "left")


def with_assigned_rider(orders: DataFrame, riders: DataFrame) -> DataFrame:
    """Orders with the detail of their assigned rider."""
    detail = riders.select(
        F.col("id").alias("assigned_rider_id"),
        "rider_name",
        F.col("vehicle_type").alias("rider_vehicle"),
        "rating",
        F.col("status").alias("rider_status"),
    )
    return orders.join(detail, "assigned_rider_id", "left")


def lookup(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a list of wanted keys (trimmed text)."""
    wanted = keys.select(F.trim(F.col(key).cast("string")).alias("_wanted")).distinct()
    return df.join(wanted, F.col(key).cast("string") == F.col("_wanted"), "left_semi")


def match_profiles(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Newest profile for each request: by email and name, else email, else name.

    Profiles are reduced to the newest id per key first, so each of the three
    joins meets at most one row per request.
    """

    def clean(c: str):
        return F.lower(F.trim(F.col(c)))

    # a profile's null never equals anything, not even a blank in a request
    known = profiles.select(
        F.col("id"), clean("contact_email").alias("_email"), clean("hotel_name").alias("_name")
    )

    def newest(*keys: str, name: str) -> DataFrame:
        return known.groupBy(*keys).agg(F.max("id").alias(name))

    asked = requests.withColumns({c: F.coalesce(clean(asked_as), F.lit("")) for c, asked_as in (("_email", "email"), ("_name", "hotel_name"))})
    found = (
        asked.join(newest("_email", "_name", name="_both"), ["_email", "_name"], "left")
        .join(newest("_email", name="_by_email"), "_email", "left")
        .join(newest("_name", name="_by_name"), "_name", "left")
    )
    how = (
        F.when(F.col("_both").isNotNull(), "email_and_name")
        .when(F.col("_by_email").isNotNull(), "email")
        .when(F.col("_by_name").isNotNull(), "name")
    )
    return found.withColumns(
        {"profile_id": F.coalesce("_both", "_by_email", "_by_name"), "matched_on": how}
    ).drop("_email", "_name", "_both", "_by_email", "_by_name")


def with_centroid(df: DataFrame, centroids: DataFrame) -> DataFrame:
    """Country centroid of each row, the default origin for unknown countries."""
    known = centroids.select("country", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    return (
        df.join(known, "country", "left")
        .withColumns(
            {
                "centroid_lat": F.coalesce("_lat", F.lit(D.DEFAULT_LAT)),
                "centroid_lng": F.coalesce("_lng", F.lit(D.DEFAULT_LNG)),
            }
        )
        .drop("_lat", "_lng")
    )


def latest_before(
    probes: DataFrame, obs: DataFrame, key: str, probe_ts: str, obs_ts: str, value: str
) -> DataFrame:
    """For each distinct (key, time) of the probes, the last ``value`` seen up to that time.

    Both sides shrink to distinct times first. Times are then read in order
    within one key and hour. What was in force when an hour began comes from the
    last value per hour of its day or, before the first of these, from the last
    value per day: tables of hours and of days. No task sorts a key's whole
    history, nor a whole day of it.
    """
    moment = F.col("_ts")
    asked = (
        probes.select(F.col(key), F.col(probe_ts).alias("_ts"))
        .where(moment.isNotNull())
        .distinct()
        .select(key, "_ts", F.lit(None).cast(dict(obs.dtypes)[value]).alias("_value"), F.lit(True).alias("_asked"))
    )
    seen = obs.select(
        F.col(key), F.col(obs_ts).alias("_ts"), F.col(value).alias("_value"), F.lit(False).alias("_asked")
    )
    both = seen.unionByName(asked).withColumn("_hour", F.date_trunc("hour", "_ts"))

    per_hour = (
        both.groupBy(key, "_hour")
        .agg(
            F.max_by("_value", F.when(~F.col("_asked"), moment)).alias("_last"),
            F.max(F.when(~F.col("_asked"), moment)).alias("_last_ts"),
        )
        .withColumn("_day", F.to_date("_hour"))
    )
    per_day = per_hour.groupBy(key, "_day").agg(F.max_by("_last", "_last_ts").alias("_last"))

    def before(*parts: str, order: str) -> Column:
        earlier = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.last("_last", ignorenulls=True).over(earlier)

    days = per_day.select(key, "_day", before(key, order="_day").alias("_day_carried"))
    carried = (
        per_hour.withColumn("_hour_carried", before(key, "_day", order="_hour"))
        .join(days, [key, "_day"], "left")
        .select(key, "_hour", F.coalesce("_hour_carried", "_day_carried").alias("_carried"))
    )
    # At equal times observations come before probes.
    in_hour = (
        Window.partitionBy(key, "_hour")
        .orderBy("_ts", "_asked")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        both.withColumn("_in_hour", F.last("_value", ignorenulls=True).over(in_hour))
        .where("_asked")
        .join(carried, [key, "_hour"], "left")
        .select(
            key, F.col("_ts").alias(probe_ts), F.coalesce("_in_hour", "_carried").alias(value)
        )
    )


def with_weather_in_force(orders: DataFrame, observations: DataFrame, ts: str) -> DataFrame:
    """Orders with the weather of the last observation of their hotel up to ``ts``; else Clear.

    Of several observations at one time the highest id counts.
    """
    per_time = observations.groupBy("hotel_id", "obs_ts").agg(
        F.max_by(F.struct("obs_id", "weathercode", "windspeed"), F.col("obs_id")).alias("obs")
    )
    in_force = latest_before(orders, per_time, "hotel_id", ts, "obs_ts", "obs")
    label = weather_class(F.col("obs.weathercode"), F.col("obs.windspeed"))
    return (
        orders.join(in_force, ["hotel_id", ts], "left")
        .withColumn("weather_now", label)
        .withColumn("obs_id", F.col("obs.obs_id"))
        .drop("obs")
    )


def choose_models(orders: DataFrame, registry: DataFrame) -> DataFrame:
    """Orders with the model of their hotel, or the default where it has none."""
    custom = registry.select("hotel_id", F.col("model_id").alias("_custom"))
    return (
        orders.join(custom, "hotel_id", "left")
        .withColumn("model_id", F.coalesce("_custom", F.lit("default")))
        .drop("_custom")
    )


def cv_against_test(cv: DataFrame, test: DataFrame) -> DataFrame:
    """Cross-validation means next to holdout metrics per model, with their differences."""
    joined = cv.join(test, "model")
    gaps = {
        f"{m}_diff": F.round(F.col(m) - F.col(f"cv_{m}"), 4) for m in ("mae", "rmse", "r2")
    }
    return joined.withColumns(gaps)
