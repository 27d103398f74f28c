"""Row-producing geographic operators: routes, seed fleets, coordinate checks, address phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierflow import domain as D
from courierflow.functions import geo
from courierflow.operators.matching import with_centroid

# The two default Manhattan points and the tolerances around them.
DEFAULT_POINTS = [(40.7580, -73.9855), (40.7306, -73.9866)]
DEFAULT_POINT_TOLERANCE = 0.15
COUNTRY_LAT_TOLERANCE = 25.0
HOME_COUNTRY = "United States"

# Phrases never looked up, and the shortest segment worth a lookup.
STOP_PHRASES = ["main campus", "mini market", "street address", "main branch", "road branch"]
MIN_SEGMENT = 3

# Addresses whose phrases one task makes.
ROWS_PER_TASK = 20_000

# Station used where neither rider nor hotel has a position.
STATION_LAT, STATION_LNG = 24.838519, 67.081033

# Starter fleet as name, phone, email, vehicle, experience, rating, status,
# latitude offset, longitude offset, address pattern, deliveries, on time, score.
STARTER_FLEET = [
    ("Tariq Khan", "+92 300 1234567", "tariq.courier@example.com", "Scooter", 3.5, 4.9,
     "Available", 0.007, 0.005, "Near %s", 18, 17, 94.4),
    ("Ali Raza", "+92 321 9876543", "ali.courier@example.com", "Scooter", 2.0, 4.7,
     "On Delivery", 0.014, 0.011, "En Route from %s", 12, 11, 91.7),
    ("Usman Ahmed", "+92 333 4567890", "usman.courier@example.com", "Car", 5.0, 5.0,
     "Available", -0.009, -0.007, "Station Hub, %s", 25, 25, 100.0),
    ("Bilal Shah", "+92 345 6789012", "bilal.courier@example.com", "Bike", 1.5, 4.6,
     "Offline", 0.002, -0.003, "Rest Point, %s", 8, 7, 87.5),
]


def route_table(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per route point of (origin_lat, origin_lng, dest_lat, dest_lng)."""
    points = geo.route_points(
        F.col("origin_lat"), F.col("origin_lng"), F.col("dest_lat"), F.col("dest_lng")
    )
    exploded = df.select(*keys, F.posexplode(points).alias("step", "point"))
    return exploded.select(*keys, "step", "point.lat", "point.lng")


def seed_fleet(
    hotels: DataFrame, riders: DataFrame, area_column: str = "branch_or_address"
) -> DataFrame:
    """Four starter riders for each hotel that has none."""
    without = hotels.join(riders.select("hotel_id"), "hotel_id", "left_anti")
    area = F.coalesce(F.nullif(F.trim(F.col(area_column)), F.lit("")), F.lit("Dispatch Hub"))
    lat = F.coalesce(F.nullif(F.col("latitude"), F.lit(0.0)), F.lit(D.DEFAULT_LAT))
    lng = F.coalesce(F.nullif(F.col("longitude"), F.lit(0.0)), F.lit(D.DEFAULT_LNG))

    def member(row: tuple) -> Column:
        name, phone, email, vehicle, years, rating, status, d_lat, d_lng, place, total, ontime, score = row
        return F.struct(
            F.lit(name).alias("rider_name"),
            F.lit(phone).alias("phone"),
            F.lit(email).alias("email"),
            F.lit(vehicle).alias("vehicle_type"),
            F.lit(years).alias("courier_exp_yrs"),
            F.lit(rating).alias("rating"),
            F.lit(status).alias("status"),
            F.round(lat + d_lat, 6).alias("current_lat"),
            F.round(lng + d_lng, 6).alias("current_lng"),
            F.format_string(place, area).alias("current_address"),
            F.lit(total).cast("bigint").alias("total_deliveries"),
            F.lit(ontime).cast("bigint").alias("on_time_deliveries"),
            F.lit(score).alias("performance_score"),
        )

    return without.select("hotel_id", F.inline(F.array(*[member(r) for r in STARTER_FLEET])))


def rider_positions(riders: DataFrame, hotels: DataFrame) -> DataFrame:
    """Riders without a position get one near their hotel, repeatable per rider id."""
    at = hotels.select("hotel_id", "latitude", "longitude")
    joined = riders.join(at, "hotel_id", "left")
    own = geo.has_point(F.col("current_lat"), F.col("current_lng"))
    hotel_known = F.coalesce((F.col("latitude") != 0) & (F.col("longitude") != 0), F.lit(False))

    def place(mine: str, base: str, salt: str, station: float) -> Column:
        near = F.round(F.col(base) + geo.jitter(F.col("id"), salt), 6)
        return F.when(own, F.col(mine)).when(hotel_known, near).otherwise(F.lit(station))

    return joined.withColumns(
        {
            "tracking_source": F.when(own, "device").when(hotel_known, "hotel").otherwise("station"),
            "current_lat": place("current_lat", "latitude", "lat", STATION_LAT),
            "current_lng": place("current_lng", "longitude", "lng", STATION_LNG),
        }
    ).drop("latitude", "longitude")


def near_default_point(lat: Column, lng: Column) -> Column:
    close = [
        (F.abs(lat - p_lat) < DEFAULT_POINT_TOLERANCE) & (F.abs(lng - p_lng) < DEFAULT_POINT_TOLERANCE)
        for p_lat, p_lng in DEFAULT_POINTS
    ]
    return close[0] | close[1]


def resolve_coordinates(profiles: DataFrame, centroids: DataFrame) -> DataFrame:
    """Keep plausible user coordinates, otherwise take the country's centroid.

    ``profiles`` has country, latitude and longitude; ``centroids`` is the fixed
    country table. Adds lat, lng and where they come from.
    """
    country = F.coalesce(F.nullif(F.trim(F.col("country")), F.lit("")), F.lit(HOME_COUNTRY))
    known = centroids.select(
        F.col("country").alias("_country"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng")
    )
    joined = profiles.withColumn("country", country).join(
        known, F.col("country") == F.col("_country"), "left"
    )
    hub_lat = F.coalesce("_lat", F.lit(D.DEFAULT_LAT))
    hub_lng = F.coalesce("_lng", F.lit(D.DEFAULT_LNG))
    lat, lng = F.col("latitude"), F.col("longitude")
    home = F.col("country") == HOME_COUNTRY
    plausible = home | (F.abs(lat - hub_lat) < COUNTRY_LAT_TOLERANCE)
    keep = F.coalesce((home | ~near_default_point(lat, lng)) & plausible, F.lit(False))
    return joined.withColumns(
        {
            "lat": F.when(keep, lat).otherwise(hub_lat),
            "lng": F.when(keep, lng).otherwise(hub_lng),
            "source": F.when(keep, "user").otherwise("country"),
        }
    ).drop("_country", "_lat", "_lng")


def dealt(rows: DataFrame) -> DataFrame:
    """The rows in parts of at most ``ROWS_PER_TASK`` or so, however few files they come from.

    A table that is small already keeps its parts.
    """
    wanted = -(-rows.count() // ROWS_PER_TASK)
    return rows.repartition(wanted, *rows.columns) if wanted > 1 else rows


def address_phrases(df: DataFrame, keys: list[str], address: str) -> DataFrame:
    """Lookup candidates of an address, best first: all of it, segments, then 4-, 3- and 2-word runs."""
    clean = F.trim(F.col(address))
    segments = F.filter(
        F.transform(F.split(clean, "[,;/\n]+"), lambda s: F.trim(s)),
        lambda s: F.length(s) > MIN_SEGMENT,
    )
    words = F.split(clean, "\\s+")

    def runs(n: int) -> Column:
        last = F.size(words) - n
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        joined = F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, n), " "))
        return F.filter(joined, lambda p: ~F.lower(p).isin(STOP_PHRASES))

    phrases = F.concat(F.array(clean), segments, runs(4), runs(3), runs(2))
    # an address of some bytes becomes dozens of phrases: small parts, not parts sized by their bytes
    kept = dealt(df.where(F.coalesce(F.length(clean) > 0, F.lit(False))))
    return kept.select(*keys, F.posexplode(phrases).alias("priority", "phrase"))


def match_gazetteer(phrases: DataFrame, gazetteer: DataFrame, keys: list[str]) -> DataFrame:
    """Best matching place per key: the earliest phrase that names a known place.

    ``gazetteer`` has one row per lower-case name. The pick is an aggregate, so
    it combines before the shuffle.
    """
    named = phrases.withColumn("name_key", F.lower("phrase")).join(gazetteer, "name_key")
    best = F.min_by(F.struct("phrase", "lat", "lng"), F.col("priority")).alias("best")
    return named.groupBy(*keys).agg(best).select(*keys, "best.phrase", "best.lat", "best.lng")


def locate_addresses(
    df: DataFrame, keys: list[str], address: str, country: str, gazetteer: DataFrame, centroids: DataFrame
) -> DataFrame:
    """Every row's place: the best phrase of its address, else the centroid of its country.

    ``source`` tells which; an unknown country stands at the default origin.
    """
    found = match_gazetteer(address_phrases(df, keys, address), gazetteer, keys)
    asked = df.select(*keys, F.col(country).alias("country"))
    placed = with_centroid(asked, centroids).join(found, keys, "left")
    matched = F.col("phrase").isNotNull()
    return placed.select(
        *keys,
        "phrase",
        F.when(matched, F.col("lat")).otherwise(F.col("centroid_lat")).alias("lat"),
        F.when(matched, F.col("lng")).otherwise(F.col("centroid_lng")).alias("lng"),
        F.when(matched, "address").otherwise("country").alias("source"),
    )
