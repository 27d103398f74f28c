"""Column-name normalization and default imputation for uploaded delivery tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierflow import domain as D

# Accepted synonyms of each canonical column.
COLUMN_SYNONYMS = {
    "distance_km": [
        "distance_km", "distance", "dist", "distance (km)", "distance(km)", "km", "trip_distance",
        "delivery_distance", "dist_km", "distance in km",
    ],
    "weather": [
        "weather", "weather_condition", "weather condition", "climate", "conditions",
        "weather_type", "weather_status", "sky",
    ],
    "traffic_level": [
        "traffic_level", "traffic level", "trafficlevel", "traffic", "traffic_condition",
        "traffic condition", "congestion", "road_traffic", "traffic_status",
    ],
    "time_of_day": [
        "time_of_day", "time of day", "timeofday", "time", "order_time", "order time", "timing",
        "shift", "tod", "day_time", "daytime", "period", "hour_slot",
    ],
    "vehicle_type": [
        "vehicle_type", "vehicle type", "vehicletype", "vehicle", "transport", "transport_type",
        "transport type", "fleet", "mode", "delivery_vehicle", "delivery_mode", "bike_or_car",
        "ride_type", "vehicle_mode",
    ],
    "preparation_time_min": [
        "preparation_time_min", "preparation_time", "preparation time", "prep_time", "prep time",
        "preptime", "prep_time_min", "kitchen_time", "kitchen time", "prep (min)", "prep(min)",
        "preparation (min)", "prep_duration", "cook_time", "cooking_time", "prep_minutes",
        "food_prep_time",
    ],
    "courier_experience_yrs": [
        "courier_experience_yrs", "courier_experience", "courier experience", "courierexperience",
        "experience", "experience_yrs", "experience (years)", "experience(yrs)",
        "experience(years)", "rider_experience", "rider experience", "driver_experience",
        "driver experience", "rider_exp", "courier_exp", "years_of_experience", "years_experience",
        "exp", "courier_years", "driver_exp",
    ],
    "delivery_time_min": [
        "delivery_time_min", "delivery_time", "delivery time", "deliverytime", "delivery_duration",
        "delivery duration", "duration", "time_min", "time taken", "time_taken", "minutes",
        "actual_delivery_time", "total_delivery_time", "delivery_time(min)", "delivery_time (min)",
        "trip_time", "eta_min", "target", "actual_time", "duration_min",
    ],
}

# Fragments that hint at a column, tried in this order.
COLUMN_HINTS = [
    ("distance_km", ["dist"]),
    ("traffic_level", ["traffic"]),
    ("weather", ["weather"]),
    ("preparation_time_min", ["prep", "cook"]),
    ("courier_experience_yrs", ["courier", "rider", "driver", "exp"]),
    ("vehicle_type", ["vehic", "transport", "fleet"]),
    ("delivery_time_min", ["deliver", "duration"]),
]

# Synonyms lose blanks, underscores and dashes; incoming names also lose brackets
# and dots, so a synonym with brackets can only be met through a hint.
_SYNONYM_STRIP = str.maketrans("", "", " _-")
_INCOMING_STRIP = str.maketrans("", "", " _-().")


def _synonym_lookup() -> dict[str, str]:
    lookup = {}
    for canonical, listed in COLUMN_SYNONYMS.items():
        for synonym in listed:
            lookup[synonym.translate(_SYNONYM_STRIP)] = canonical
    return lookup


def plan_column_names(columns: list[str]) -> list[str]:
    """New name of each column, by position: exact synonym first, then the first free hint."""
    synonyms = _synonym_lookup()
    taken: set[str] = set()
    planned = []
    for column in columns:
        kept = column.strip()
        plain = kept.lower().translate(_INCOMING_STRIP)
        exact = synonyms.get(plain)
        if exact:
            name = kept if exact in taken else exact
        else:
            hinted = (
                canonical
                for canonical, fragments in COLUMN_HINTS
                if canonical not in taken and any(f in plain for f in fragments)
            )
            name = next(hinted, kept)
        planned.append(name)
        taken.add(name)
    return planned


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename columns to their canonical names; of equal names the first column stays.

    Works on the schema alone, so the data is not read.
    """
    planned = plan_column_names(df.columns)
    by_position = [f"_c{i}" for i in range(len(planned))]
    first_of: dict[str, int] = {}
    for i, name in enumerate(planned):
        # Column lookup ignores case, so names that differ in case only are one name.
        first_of.setdefault(name.lower(), i)
    return df.toDF(*by_position).select(
        *[F.col(by_position[i]).alias(planned[i]) for i in sorted(first_of.values())]
    )


def impute_defaults(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add absent predictors and fill empty cells with the operational defaults.

    Returns the table and the names of the columns that were absent.
    """
    present = {c.lower() for c in df.columns}
    added = [c for c in D.RAW_FEATURES if c not in present]
    filled = {}
    for column, default in D.FEATURE_DEFAULTS.items():
        value = F.lit(default)
        filled[column] = value if column in added else F.coalesce(F.col(column), value)
    return df.withColumns(filled), added
