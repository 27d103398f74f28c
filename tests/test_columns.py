from __future__ import annotations

import pytest

from courierflow import domain as D
from courierflow.operators import columns, quality
from courierflow.sources import lookups


@pytest.mark.parametrize(
    "given, planned",
    [
        (["Distance (km)", "Weather Condition"], ["distance_km", "weather"]),
        (["expected_time"], ["courier_experience_yrs"]),
        (["dist", "delivery_dist_alt"], ["distance_km", "delivery_time_min"]),
        (["dist", "distance"], ["distance_km", "distance"]),
        (["prep(min)"], ["preparation_time_min"]),
        (["Hour_Slot", "TOD"], ["time_of_day", "TOD"]),
        (["notes"], ["notes"]),
        (["FLEET", "transport mode"], ["vehicle_type", "transport mode"]),
        (["Rider Exp.", "driver rating"], ["courier_experience_yrs", "driver rating"]),
    ],
)
def test_planned_names(given, planned):
    assert columns.plan_column_names(given) == planned


def test_first_of_equal_names_stays(spark):
    df = spark.range(1).selectExpr("1.0D as dist", "2.0D as `DISTANCE_KM`")
    out = columns.normalize_columns(df)
    assert out.columns == ["distance_km"]
    assert out.first()[0] == 1.0


def test_impute_reports_only_absent_columns(spark):
    df = spark.createDataFrame([(None, "Rainy"), (3.0, None)], "distance_km double, weather string")
    filled, added = columns.impute_defaults(df)
    assert added == [c for c in D.RAW_FEATURES if c not in ("distance_km", "weather")]
    rows = filled.select("distance_km", "weather", "vehicle_type").collect()
    assert [tuple(r) for r in rows] == [(5.0, "Rainy", "Scooter"), (3.0, "Clear", "Scooter")]


def payload(**changes):
    row = dict(
        distance_km=8.5,
        weather="Clear",
        traffic_level="Medium",
        time_of_day="Evening",
        vehicle_type="Scooter",
        preparation_time_min=15.0,
        courier_experience_yrs=3.0,
    )
    return {**row, **changes}


SCHEMA = (
    "distance_km double, weather string, traffic_level string, time_of_day string, "
    "vehicle_type string, preparation_time_min double, courier_experience_yrs double"
)


@pytest.mark.parametrize(
    "changes, codes",
    [
        ({}, []),
        ({"distance_km": 0.5, "preparation_time_min": 0.0, "courier_experience_yrs": 0.0}, []),
        ({"distance_km": -3.5}, ["distance_km_range"]),
        ({"weather": "Sunny"}, ["weather_category"]),
        ({"preparation_time_min": 300.0}, ["preparation_time_min_range"]),
        ({"distance_km": -5.0, "weather": "Tornado"}, ["distance_km_range", "weather_category"]),
        ({"distance_km": None}, ["distance_km_null"]),
        ({"courier_experience_yrs": None}, []),
        ({"traffic_level": None}, ["traffic_level_category"]),
    ],
)
def test_violations(spark, changes, codes):
    df = spark.createDataFrame([payload(**changes)], SCHEMA)
    assert quality.add_violations(df).first()["violations"] == codes
    if codes:
        with pytest.raises(quality.InvalidInput):
            quality.require_valid(df)


def test_text_numbers_are_parsed_or_reported(spark):
    df = spark.createDataFrame([payload()], SCHEMA).selectExpr(
        "'8.5' as distance_km", "'fast' as preparation_time_min",
        *[c for c in D.RAW_FEATURES if c not in ("distance_km", "preparation_time_min")],
    )
    row = quality.add_violations(df).first()
    assert row["distance_km"] == 8.5
    assert row["violations"] == ["preparation_time_min_not_numeric"]


def test_missing_column_is_an_error(spark):
    df = spark.createDataFrame([payload()], SCHEMA).drop("distance_km")
    with pytest.raises(quality.InvalidInput):
        quality.add_violations(df)


def test_training_sample_has_one_unknown_weather(spark):
    sample = lookups.sample_template(spark, include_target=True)
    assert sample.count() == 15
    summary = {r["violation"]: r["rows"] for r in quality.violation_summary(sample).collect()}
    assert summary == {"weather_category": 1}


def test_lookup_sizes(spark):
    assert lookups.country_centroids(spark).count() == 176
    presets = lookups.city_presets(spark)
    assert presets.count() == 6
    assert lookups.landmarks(presets).count() == 31
    assert lookups.sample_template(spark).count() == 3
