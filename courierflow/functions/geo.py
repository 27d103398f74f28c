"""Geographic column expressions: distances, routes and drop-off points."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius, street detour, minutes per km, arc bend.
EARTH_RADIUS_KM = 6371.0
STREET_DETOUR = 1.28
MIN_ROAD_KM = 0.3
MINUTES_PER_KM = 2.4
MIN_ROUTE_MIN = 3.0
ARC_BEND = 0.15
ROUTE_STEPS = 14
FALLBACK_KM = 5.2
MIN_DELIVERY_KM = 0.5
DROP_OFF_BEARING_RAD = 0.65
KM_PER_DEGREE = 111.0
SYNTHETIC_DROP_OFF = (0.015, 0.012)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in kilometres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2.0)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(chord), F.sqrt(F.lit(1.0) - chord))


def road_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Street distance estimate, at least 0.3 km."""
    straight = haversine_km(lat1, lng1, lat2, lng2)
    return F.greatest(F.lit(MIN_ROAD_KM), F.round(straight * STREET_DETOUR, 1))


def has_point(lat: Column, lng: Column) -> Column:
    """True unless a coordinate is missing or both are zero."""
    return F.coalesce((lat != 0.0) | (lng != 0.0), F.lit(False)) & lat.isNotNull() & lng.isNotNull()


def delivery_km(
    hotel_lat: Column,
    hotel_lng: Column,
    dest_lat: Column,
    dest_lng: Column,
    fallback_km: float = FALLBACK_KM,
) -> Column:
    """Road distance to the drop-off, or the fallback where there is none."""
    known = F.round(road_km(hotel_lat, hotel_lng, dest_lat, dest_lng), 1)
    km = F.when(has_point(dest_lat, dest_lng), known).otherwise(F.round(F.lit(fallback_km), 1))
    return F.greatest(F.lit(MIN_DELIVERY_KM), km)


def route_minutes(km: Column) -> Column:
    return F.greatest(F.lit(MIN_ROUTE_MIN), F.round(km * MINUTES_PER_KM, 1))


def route_points(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Array of (lat, lng) along a gently bent line from origin to destination."""
    d_lat, d_lng = lat2 - lat1, lng2 - lng1

    def point(step: Column) -> Column:
        t = step.cast("double") / float(ROUTE_STEPS)
        bend = F.sin(t * math.pi) * ARC_BEND
        return F.struct(
            F.round(lat1 + t * d_lat - bend * d_lng, 6).alias("lat"),
            F.round(lng1 + t * d_lng + bend * d_lat, 6).alias("lng"),
        )

    return F.transform(F.sequence(F.lit(0), F.lit(ROUTE_STEPS)), point)


def drop_off_or_synthetic(
    hotel_lat: Column, hotel_lng: Column, dest_lat: Column, dest_lng: Column
) -> tuple[Column, Column]:
    """The drop-off, or a point a short way off the hotel where none was given."""
    known = has_point(dest_lat, dest_lng)
    off_lat, off_lng = SYNTHETIC_DROP_OFF
    return (
        F.when(known, dest_lat).otherwise(F.round(hotel_lat + off_lat, 6)),
        F.when(known, dest_lng).otherwise(F.round(hotel_lng + off_lng, 6)),
    )


def drop_off_at_distance(hotel_lat: Column, hotel_lng: Column, km: Column) -> tuple[Column, Column]:
    """Point at ``km`` from the hotel along the fixed north-east bearing."""
    lat_step = km / KM_PER_DEGREE * math.cos(DROP_OFF_BEARING_RAD)
    lng_step = (
        km
        / (F.lit(KM_PER_DEGREE) * F.cos(hotel_lat * math.pi / 180))
        * math.sin(DROP_OFF_BEARING_RAD)
    )
    return hotel_lat + lat_step, hotel_lng + lng_step


def jitter(key: Column, salt: str, span: float = 0.015) -> Column:
    """Repeatable offset in ``[-span/2, span/2)`` from the key's hash."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(salt)))
    unit = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double") / float(16**8)
    return (unit - 0.5) * span
