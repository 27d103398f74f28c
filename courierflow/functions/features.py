"""Engineered delivery features.

They are kept as SQL text, the form that a saved ML pipeline can carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierflow import domain as D

# Bins closed on the right at 5 and 12 km, the evening peak, the
# adverse weathers, minutes per km to 2 decimals with ties to even. A comparison with a missing value counts as "no".
FEATURE_SQL = {
    "distance_category": """case when distance_km <= 0 then null
        when distance_km <= 5 then 'Short'
        when distance_km <= 12 then 'Medium'
        when distance_km > 12 then 'Long' end""",
    "is_peak_meal_hour": "cast(coalesce(time_of_day = 'Evening', false) as int)",
    "prep_time_per_km": "rint(preparation_time_min / (distance_km + 0.00001D) * 100D) / 100D",
    "bike_long_distance": "cast(coalesce(vehicle_type = 'Bike' and distance_km > 12, false) as int)",
    "severe_conditions": """cast(coalesce(weather in ('Snowy', 'Rainy', 'Foggy')
        and traffic_level = 'High', false) as int)""",
}


def feature(name: str) -> Column:
    return F.expr(FEATURE_SQL[name])


def add_features(df: DataFrame) -> DataFrame:
    """Append the five engineered columns; one projection, no shuffle."""
    return df.withColumns({name: feature(name) for name in D.ENGINEERED_FEATURES})


def separate_features(df: DataFrame) -> DataFrame:
    """Predictors only: the order id and the target are dropped."""
    return df.drop(D.ID_COLUMN, D.TARGET)


def separate_target(df: DataFrame) -> DataFrame:
    return df.select(D.TARGET)
