"""Column names, category domains, numeric ranges, defaults and row schemas."""

from __future__ import annotations

from pyspark.sql import types as T

ID_COLUMN = "order_id"
TARGET = "delivery_time_min"

RAW_FEATURES = [
    "distance_km",
    "weather",
    "traffic_level",
    "time_of_day",
    "vehicle_type",
    "preparation_time_min",
    "courier_experience_yrs",
]
ENGINEERED_FEATURES = [
    "distance_category",
    "is_peak_meal_hour",
    "prep_time_per_km",
    "bike_long_distance",
    "severe_conditions",
]
ALL_FEATURES = RAW_FEATURES + ENGINEERED_FEATURES

NUMERIC_FEATURES = ["distance_km", "preparation_time_min", "courier_experience_yrs"]
ORDINAL_FEATURES = ["traffic_level"]
NOMINAL_FEATURES = ["weather", "time_of_day", "vehicle_type"]
FULL_NUMERIC_FEATURES = NUMERIC_FEATURES + ["prep_time_per_km"]
FULL_ORDINAL_FEATURES = ["traffic_level", "distance_category"]
BINARY_FEATURES = ["is_peak_meal_hour", "bike_long_distance", "severe_conditions"]
CATEGORY_COLUMNS = ["weather", "traffic_level", "time_of_day", "vehicle_type"]

# Category domains. Traffic and distance are ordered.
TRAFFIC_LEVELS = ["Low", "Medium", "High"]
DISTANCE_CATEGORIES = ["Short", "Medium", "Long"]
WEATHERS = ["Clear", "Rainy", "Foggy", "Snowy", "Windy"]
TIMES_OF_DAY = ["Morning", "Afternoon", "Evening", "Night"]
VEHICLES = ["Bike", "Scooter", "Car"]

CATEGORY_DOMAINS = {
    "weather": WEATHERS,
    "traffic_level": TRAFFIC_LEVELS,
    "time_of_day": TIMES_OF_DAY,
    "vehicle_type": VEHICLES,
}
ORDINAL_DOMAINS = {
    "traffic_level": TRAFFIC_LEVELS,
    "distance_category": DISTANCE_CATEGORIES,
}

# Accepted numeric ranges as (low, high, low is open).
NUMERIC_RANGES = {
    "distance_km": (0.0, 100.0, True),
    "preparation_time_min": (0.0, 180.0, False),
    "courier_experience_yrs": (0.0, 50.0, False),
}

# Operational defaults for absent or empty predictors.
FEATURE_DEFAULTS = {
    "distance_km": 5.0,
    "weather": "Clear",
    "traffic_level": "Medium",
    "time_of_day": "Evening",
    "vehicle_type": "Scooter",
    "preparation_time_min": 15.0,
    "courier_experience_yrs": 3.0,
}

# Delay-risk labels.
RISK_FAST = "Fast / Low Risk"
RISK_STANDARD = "Standard / Medium Risk"
RISK_HIGH = "High Delay Risk"

# Dispatch life cycle.
PENDING = "Pending_Rider"
ACTIVE = "Active"
DELIVERED = "Delivered"
UNASSIGNED = "Unassigned_No_Riders"
RESPONSE_MINUTES = 5
ON_TIME_GRACE_MIN = 2.0

KITCHEN_STATUSES = ["Pending", "Preparing", "Ready", "Completed"]

# Origin used where a hotel has no coordinates.
DEFAULT_LAT = 40.7306
DEFAULT_LNG = -73.9866

DELIVERY_SCHEMA = T.StructType(
    [
        T.StructField("order_id", T.LongType()),
        T.StructField("distance_km", T.DoubleType()),
        T.StructField("weather", T.StringType()),
        T.StructField("traffic_level", T.StringType()),
        T.StructField("time_of_day", T.StringType()),
        T.StructField("vehicle_type", T.StringType()),
        T.StructField("preparation_time_min", T.DoubleType()),
        T.StructField("courier_experience_yrs", T.DoubleType()),
        T.StructField("delivery_time_min", T.DoubleType()),
    ]
)

WEATHER_OBS_SCHEMA = T.StructType(
    [
        T.StructField("obs_id", T.LongType()),
        T.StructField("hotel_id", T.LongType()),
        T.StructField("obs_ts", T.TimestampType()),
        T.StructField("weathercode", T.LongType()),
        T.StructField("windspeed", T.DoubleType()),
    ]
)

DISPATCH_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("order_no", T.LongType()),
        T.StructField("rider_id", T.LongType()),
        T.StructField("action", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

MODEL_REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("mae", T.DoubleType()),
        T.StructField("mse", T.DoubleType()),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("r2", T.DoubleType()),
        T.StructField("notes", T.StringType()),
    ]
)
