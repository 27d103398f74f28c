"""FE*, PP*, SC*, GE*: features, preparation, scalar rules and geography."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from courierflow import domain as D
from courierflow.catalog.base import query
from courierflow.catalog.quality import FEATURED_SQL, SPLIT_SQL
from courierflow.functions import features, geo, scalars
from courierflow.operators import geodata, preparation, quality, splitting
from courierflow.sources import lookups
from courierflow.sources.binding import Tables


def feature(t: Tables, name: str):
    return features.add_features(t.deliveries).select("order_id", name)


def fitted(t: Tables, engineered: bool = True):
    rows = splitting.with_split(features.add_features(t.deliveries))
    prepared = preparation.fit_preparation(rows.where("split = 'train'"), engineered)
    return rows, prepared


def rounded(df, *keep: str):
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in df.columns if c not in keep])


def imputed_numbers(t: Tables):
    rows, prepared = fitted(t)
    return prepared.impute(rows).select("order_id", *D.FULL_NUMERIC_FEATURES)


def imputed_categories(t: Tables):
    rows, prepared = fitted(t)
    return prepared.impute(rows).select("order_id", *D.FULL_ORDINAL_FEATURES, *D.NOMINAL_FEATURES)


def matrix_part(t: Tables, suffixes: tuple[str, ...], engineered: bool = True):
    rows, prepared = fitted(t, engineered)
    matrix = rounded(prepared.matrix(rows, "order_id"), "order_id")
    return matrix.select(
        "order_id", *[c for c in matrix.columns if c.endswith(suffixes) and c != "order_id"]
    )


# Oracle: statistics of the training rows, then the matrix built from them.
SPLIT_FEATURED = FEATURED_SQL.replace("from deliveries", "from split_rows")
FIT_STATS = (
    "select "
    + ", ".join(f"median({c}) as med_{c}" for c in D.FULL_NUMERIC_FEATURES)
    + " from split_featured where split = 'train'"
)
FIT_MODES = "select " + ", ".join(
    f"(select {c} from split_featured where split = 'train' and {c} is not null "
    f"group by {c} order by count(*) desc, {c} limit 1) as mode_{c}"
    for c in [*D.FULL_ORDINAL_FEATURES, *D.NOMINAL_FEATURES]
)
FILLED = (
    "select order_id, split, "
    + ", ".join(f"coalesce({c}, med_{c}) as {c}" for c in D.FULL_NUMERIC_FEATURES)
    + ", "
    + ", ".join(f"coalesce({c}, mode_{c}) as {c}" for c in [*D.FULL_ORDINAL_FEATURES, *D.NOMINAL_FEATURES])
    + ", "
    + ", ".join(D.BINARY_FEATURES)
    + " from split_featured, fit_stats, fit_modes"
)
SCALES = (
    "select "
    + ", ".join(
        f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in D.FULL_NUMERIC_FEATURES
    )
    + " from filled where split = 'train'"
)
FIT_CTES = {
    "split_rows": SPLIT_SQL,
    "split_featured": SPLIT_FEATURED,
    "fit_stats": FIT_STATS,
    "fit_modes": FIT_MODES,
    "filled": FILLED,
    "scales": SCALES,
}


def _scaled(columns):
    return [f"round(({c} - m_{c}) / s_{c}, 6) as {c}_scaled" for c in columns]


def _codes(columns):
    return [
        f"cast(list_position({D.ORDINAL_DOMAINS[c]}, {c}) - 1 as double) as {c}_code" for c in columns
    ]


def _hot():
    return [
        f"cast({c} = '{level}' as int)::double as {c}_{level.lower()}"
        for c in D.NOMINAL_FEATURES
        for level in sorted(D.CATEGORY_DOMAINS[c])
    ]


def _flags():
    return [f"cast({c} as double) as {c}_flag" for c in D.BINARY_FEATURES]


def matrix_sql(*parts: list[str]) -> str:
    return "select order_id, " + ", ".join(c for p in parts for c in p) + " from filled, scales"


HOT_SUFFIXES = tuple(f"{c}_{lvl.lower()}" for c in D.NOMINAL_FEATURES for lvl in D.CATEGORY_DOMAINS[c])


def couriers_at_hotels(t: Tables):
    return t.riders.join(t.hotels.select("hotel_id", "latitude", "longitude"), "hotel_id")


def rider_legs(t: Tables):
    """Legs from each rider's position to the hotel; a rider without one stands at (0, 0)."""
    return couriers_at_hotels(t).select(
        F.col("id").alias("rider_id"),
        F.col("latitude").alias("origin_lat"),
        F.col("longitude").alias("origin_lng"),
        F.col("current_lat").alias("dest_lat"),
        F.col("current_lng").alias("dest_lng"),
    )


def leg(fn):
    return fn(F.col("origin_lat"), F.col("origin_lng"), F.col("dest_lat"), F.col("dest_lng"))


def destinations(t: Tables):
    """Deliveries with a drop-off around their hotel; some have none."""
    at = t.hotels.select("hotel_id", "latitude", "longitude")
    offset = (F.col("order_id") % 401 - 200).cast("double") / 10000
    other = (F.col("order_id") * 7 % 401 - 200).cast("double") / 10000
    hole = F.col("order_id") % 10
    return (
        t.deliveries.select("order_id", "hotel_id", "distance_km")
        .join(at, "hotel_id")
        .withColumns(
            {
                "dest_lat": F.when(hole == 3, F.lit(0.0)).when(hole != 4, F.round(F.col("latitude") + offset, 6)),
                "dest_lng": F.when(hole == 3, F.lit(0.0)).when(hole != 4, F.round(F.col("longitude") + other, 6)),
            }
        )
    )


HAV_SQL = (
    "12742.0e0 * atan2(sqrt({a}), sqrt(1 - {a}))".replace(
        "{a}",
        "(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        " * pow(sin(radians({lng2} - {lng1}) / 2), 2))",
    )
)


def hav(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return (
        HAV_SQL.replace("{lat1}", lat1).replace("{lng1}", lng1).replace("{lat2}", lat2).replace("{lng2}", lng2)
    )


LEGS_SQL = """
select id as rider_id, latitude as origin_lat, longitude as origin_lng, current_lat as dest_lat, current_lng as dest_lng
from riders join hotels using (hotel_id)
"""
DEST_SQL = """
select order_id, hotel_id, distance_km, latitude, longitude,
  case order_id % 10 when 3 then 0.0e0 when 4 then null else round(latitude + cast(order_id % 401 - 200 as double) / 10000, 6) end as dest_lat,
  case order_id % 10 when 3 then 0.0e0 when 4 then null else round(longitude + cast(order_id * 7 % 401 - 200 as double) / 10000, 6) end as dest_lng
from deliveries join hotels using (hotel_id)
"""
LEG = hav("origin_lat", "origin_lng", "dest_lat", "dest_lng")
DEST = hav("latitude", "longitude", "dest_lat", "dest_lng")

COUNTRIES_SQL = "select * from (values {}) as c(country, lat, lng)".format(
    ", ".join(
        "('{}', {}e0, {}e0)".format(country.replace("'", "''"), lat, lng)
        for country, lat, lng in lookups.COUNTRIES
    )
)


def printed_ids(t: Tables):
    """Six-digit tracking ids, which collide; some orders were also given the id of another one."""
    key = F.col("id")
    given = F.when(key % 500 == 7, 3).when(key % 50 == 4, key - 4).otherwise(key)
    return t.dispatch_orders.select("id", scalars.tracking_id(given, digits=6).alias("tracking_id"))


# The first nations stand for listed countries; the others keep names that no list has.
LISTED = [country for country, *_ in lookups.COUNTRIES][:20]


def profiles(t: Tables):
    """Customers as hotel sign-ups with a country and entered coordinates."""
    key = F.col("n_nationkey")
    listed = F.get(F.array(*[F.lit(c) for c in LISTED]), key.cast("int"))
    nation = t.nation.select(key.alias("c_nationkey"), F.coalesce(listed, F.initcap("n_name")).alias("country"))
    key = F.col("c_custkey")
    return t.customer.join(nation, "c_nationkey").select(
        F.col("c_custkey").alias("profile_id"),
        "country",
        F.when(key % 5 == 0, F.lit(40.75))
        .when(key % 5 == 1, (key % 120 - 60).cast("double"))
        .when(key % 5 == 2, F.lit(None))
        .otherwise((key % 60).cast("double"))
        .alias("latitude"),
        F.when(key % 5 == 0, F.lit(-73.98)).when(key % 5 != 2, (key % 170).cast("double")).alias("longitude"),
    )


LISTED_SQL = "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in LISTED) + "]"
PROFILES_SQL = f"""
select c_custkey as profile_id, coalesce(({LISTED_SQL})[n_nationkey + 1], upper(left(n_name, 1)) || lower(substr(n_name, 2))) as country,
  case c_custkey % 5 when 0 then 40.75e0 when 1 then cast(c_custkey % 120 - 60 as double) when 2 then null
    else cast(c_custkey % 60 as double) end as latitude,
  case c_custkey % 5 when 0 then -73.98e0 when 2 then null else cast(c_custkey % 170 as double) end as longitude
from customer join nation on c_nationkey = n_nationkey
"""
# Kept is: user coordinates that are not an accidental default of another country.
RESOLVE_SQL = """
select profile_id, country, case when kept then latitude else hub_lat end as lat,
  case when kept then longitude else hub_lng end as lng, case when kept then 'user' else 'country' end as source
from (select *, coalesce((country = 'United States' or not (
    (abs(latitude - 40.758e0) < 0.15 and abs(longitude + 73.9855e0) < 0.15)
    or (abs(latitude - 40.7306e0) < 0.15 and abs(longitude + 73.9866e0) < 0.15)))
    and (country = 'United States' or abs(latitude - hub_lat) < 25), false) as kept
  from (select p.*, coalesce(c.lat, 40.7306e0) as hub_lat, coalesce(c.lng, -73.9866e0) as hub_lng
    from profile_rows p left join country_rows c on p.country = c.country))
"""


def addresses(t: Tables):
    """Customers with a free-text address naming a nation."""
    nation = t.nation.select(
        F.col("n_nationkey").alias("c_nationkey"), F.initcap("n_name").alias("n_name")
    )
    return t.customer.join(nation, "c_nationkey").select(
        F.col("c_custkey").alias("profile_id"),
        F.concat(
            F.lit("Shop "),
            F.col("c_custkey"),
            F.lit(" Main Campus Road; "),
            F.initcap("c_mktsegment"),
            F.lit(" Mini Market / "),
            "n_name",
            F.lit(", 7"),
        ).alias("address"),
    )


ADDRESS_SQL = """
select c_custkey as profile_id, 'Shop ' || c_custkey || ' Main Campus Road; ' || upper(left(c_mktsegment, 1))
  || lower(substr(c_mktsegment, 2)) || ' Mini Market / ' || upper(left(n_name, 1)) || lower(substr(n_name, 2)) || ', 7' as address
from customer join nation on c_nationkey = n_nationkey
"""
PHRASES_SQL = """
select profile_id, cast(generate_subscripts(phrases, 1) - 1 as int) as priority, unnest(phrases) as phrase from (
  select profile_id, [trim(address)] || list_filter(list_transform(regexp_split_to_array(address, '[,;/\\n]+'), lambda s: trim(s)), lambda s: len(s) > 3)
    || run4 || run3 || run2 as phrases
  from (select profile_id, address, {}
    from (select *, regexp_split_to_array(address, '\\s+') as w from address_rows)))
""".format(
    ", ".join(
        f"list_filter(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' ')), "
        "lambda p: lower(p) not in ('main campus','mini market','street address','main branch','road branch')) "
        f"as run{n}"
        for n in (4, 3, 2)
    )
)


def gazetteer(t: Tables):
    at = t.hotels.select("hotel_name", F.col("latitude").alias("lat"), F.col("longitude").alias("lng"))
    return at.select(F.lower("hotel_name").alias("name_key"), "lat", "lng")


def full_gazetteer(t: Tables):
    """The hotels, and one place known only by its whole address."""
    whole = t.hotels.agg(F.lit("shop 7, harbour street").alias("name_key"), F.lit(1.5).alias("lat"), F.lit(2.5).alias("lng"))
    return gazetteer(t).unionByName(whole)


def known_and_unknown_addresses(t: Tables):
    """All addresses, and as many that only their whole text or their country tells."""
    given = addresses(t).select("profile_id", "address")
    new = given.select(
        (-F.col("profile_id")).alias("profile_id"),
        F.when(F.col("profile_id") % 2 == 0, " Shop 7, Harbour Street ").otherwise("Nowhere 5").alias("address"),
    )
    country = F.when(F.col("profile_id") % 3 == 0, "Pakistan").when(F.col("profile_id") % 3 == 1, "Atlantis")
    return given.unionByName(new).withColumn("country", country)


LOCATED_SQL = """
select *, case profile_id % 3 when 0 then 'Pakistan' when 1 then 'Atlantis' end as country from (
  select profile_id, address from address_rows
  union all select -profile_id, case when profile_id % 2 = 0 then ' Shop 7, Harbour Street ' else 'Nowhere 5' end from address_rows)
"""


def old_and_new_hotels(t: Tables):
    """All hotels, and as many new ones that no rider belongs to."""
    return t.hotels.unionByName(t.hotels.withColumn("hotel_id", F.col("hotel_id") + 1000))


QUERIES = [
    query(
        "fe1_separate_features",
        lambda t: features.separate_features(t.deliveries).select(*D.RAW_FEATURES),
        "select " + ", ".join(D.RAW_FEATURES) + " from deliveries",
    ),
    *[
        query(key, lambda t, n=name: feature(t, n), f"select order_id, {name} from featured", featured=FEATURED_SQL)
        for key, name in [
            ("fe2_distance_category", "distance_category"),
            ("fe3_peak_meal_hour", "is_peak_meal_hour"),
            ("fe4_prep_time_per_km", "prep_time_per_km"),
            ("fe5_bike_long_distance", "bike_long_distance"),
            ("fe6_severe_conditions", "severe_conditions"),
        ]
    ],
    query(
        "fe7_engineer_features",
        lambda t: features.add_features(t.deliveries).select("order_id", *D.ALL_FEATURES),
        "select order_id, " + ", ".join(D.ALL_FEATURES) + " from featured",
        featured=FEATURED_SQL,
    ),
    query(
        "pp1_median_impute",
        imputed_numbers,
        "select order_id, " + ", ".join(D.FULL_NUMERIC_FEATURES) + " from filled",
        **FIT_CTES,
    ),
    query(
        "pp2_mode_impute",
        imputed_categories,
        "select order_id, " + ", ".join([*D.FULL_ORDINAL_FEATURES, *D.NOMINAL_FEATURES]) + " from filled",
        **FIT_CTES,
    ),
    query(
        "pp3_standard_scale",
        lambda t: matrix_part(t, ("_scaled",)),
        matrix_sql(_scaled(D.FULL_NUMERIC_FEATURES)),
        **FIT_CTES,
    ),
    query(
        "pp4_ordinal_encode",
        lambda t: matrix_part(t, ("_code",)),
        matrix_sql(_codes(D.FULL_ORDINAL_FEATURES)),
        **FIT_CTES,
    ),
    query("pp5_one_hot", lambda t: matrix_part(t, HOT_SUFFIXES), matrix_sql(_hot()), **FIT_CTES),
    query(
        "pp6_matrix_21_columns",
        lambda t: matrix_part(t, ("",)),
        matrix_sql(_scaled(D.FULL_NUMERIC_FEATURES), _codes(D.FULL_ORDINAL_FEATURES), _hot(), _flags()),
        **FIT_CTES,
    ),
    query(
        "pp6_matrix_16_columns",
        lambda t: matrix_part(t, ("",), engineered=False),
        matrix_sql(_scaled(D.NUMERIC_FEATURES), _codes(D.ORDINAL_FEATURES), _hot()),
        **FIT_CTES,
    ),
    query(
        "pp7_train_test_split",
        lambda t: splitting.with_split(t.deliveries).select("order_id", "split"),
        "select order_id, split from split_rows",
        split_rows=SPLIT_SQL,
    ),
    query(
        "pp7_exact_split_per_hotel",
        lambda t: splitting.with_exact_split(
            t.deliveries.select("order_id", "hotel_id"), "order_id", F.ceil(F.col("n") * 0.2), ["hotel_id"]
        ).select("order_id", "hotel_id", "split"),
        """select order_id, hotel_id, case when pos <= ceil(n * 0.2e0) then 'test' else 'train' end as split
        from (select order_id, hotel_id, count(*) over (partition by hotel_id) as n,
          row_number() over (partition by hotel_id order by ('0x' || left(md5(order_id || '|42'), 15))::bigint, order_id) as pos
          from deliveries)""",
    ),
    query(
        "sc1_time_of_day",
        lambda t: t.dispatch_events.select("event_id", scalars.time_of_day(F.col("ts")).alias("time_of_day")),
        """select event_id, case when hour(ts) between 5 and 11 then 'Morning' when hour(ts) between 12 and 16 then 'Afternoon'
        when hour(ts) between 17 and 21 then 'Evening' else 'Night' end as time_of_day from dispatch_events""",
    ),
    query(
        "sc2_weather_class",
        lambda t: t.weather_obs.select(
            "obs_id", scalars.weather_class(F.col("weathercode"), F.col("windspeed")).alias("weather")
        ),
        """select obs_id, case when windspeed >= 28 then 'Windy' when weathercode in (45,48) then 'Foggy'
        when weathercode in (51,53,55,56,57,61,63,65,66,67,80,81,82,95,96,99) then 'Rainy'
        when weathercode in (71,73,75,77,85,86) then 'Snowy' else 'Clear' end as weather from weather_obs""",
    ),
    query(
        "sc3_delay_risk",
        lambda t: t.dispatch_orders.select("id", scalars.delay_risk(F.col("predicted_eta_min")).alias("risk_status")),
        """select id, case when predicted_eta_min <= 35 then 'Fast / Low Risk' when predicted_eta_min <= 50
        then 'Standard / Medium Risk' else 'High Delay Risk' end as risk_status from dispatch_orders""",
    ),
    query(
        "sc4_contact_defaults",
        lambda t: t.customer.select(
            "c_custkey",
            scalars.contact_email(
                F.when(F.col("c_custkey") % 4 == 0, F.lit("  ")).when(
                    F.col("c_custkey") % 4 == 1, F.concat(F.lit(" c"), "c_custkey", F.lit("@mail.com "))
                ),
                F.concat(F.col("c_mktsegment"), F.lit(" "), F.col("c_custkey")),
            ).alias("email"),
        ),
        """select c_custkey, case when c_custkey % 4 = 1 then 'c' || c_custkey || '@mail.com'
        else replace(lower(c_mktsegment || ' ' || c_custkey), ' ', '.') || '@example.com' end as email from customer""",
    ),
    query(
        "sc5_alias_columns",
        lambda t: t.deliveries.select(
            "order_id",
            scalars.first_given(
                F.when(F.col("order_id") % 3 == 0, F.col("weather")), F.col("time_of_day"), F.lit("none")
            ).alias("label"),
        ),
        """select order_id, coalesce(case when order_id % 3 = 0 then weather end, time_of_day, 'none') as label
        from deliveries""",
    ),
    query(
        "sc6_display_timestamp",
        lambda t: t.dispatch_events.select(
            "event_id",
            scalars.display_timestamp(
                F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("day T"), "event_id", F.lit(" of the long log")))
                .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
            ).alias("shown"),
        ),
        """select event_id, case when event_id % 7 = 0 then replace(left('day T' || event_id || ' of the long log', 19), 'T', ' ')
        else strftime(ts, '%Y-%m-%d %H:%M:%S') end as shown from dispatch_events""",
    ),
    query(
        "sc7_id_lists",
        lambda t: t.dispatch_orders.select(
            "id",
            F.array_join(
                scalars.parse_id_list(
                    F.when(F.col("id") % 3 == 0, F.concat(F.lit("["), "id", F.lit(", "), "assigned_rider_id", F.lit("]")))
                    .when(F.col("id") % 3 == 1, F.concat("id", F.lit(", x,"), "assigned_rider_id"))
                    .otherwise(F.lit(""))
                ),
                ";",
            ).alias("ids"),
        ),
        """select id, case when id % 3 < 2 then id || ';' || assigned_rider_id else '' end as ids from dispatch_orders""",
    ),
    query(
        "sc7_json_payload",
        lambda t: t.dispatch_orders.select(
            F.from_json(
                F.to_json(F.struct("id", "tracking_id", "hotel_id", "weather", "dispatch_status")),
                "id bigint, tracking_id string, hotel_id bigint, weather string, dispatch_status string",
            ).alias("p")
        ).select("p.*"),
        "select id, tracking_id, hotel_id, weather, dispatch_status from dispatch_orders",
    ),
    query(
        "sc8_tracking_id",
        lambda t: t.dispatch_orders.select("id", scalars.tracking_id(F.col("id")).alias("tracking_id")),
        "select id, 'TRK-' || upper(left(sha256(id || '|42'), 32)) as tracking_id from dispatch_orders",
    ),
    query(
        "sc8_duplicate_ids",
        lambda t: quality.repeated_ids(printed_ids(t), "tracking_id"),
        """select tracking_id, count(*) as copies
        from (select 'TRK-' || upper(left(sha256(case when id % 500 = 7 then 3 when id % 50 = 4 then id - 4 else id end || '|42'), 6)) as tracking_id
          from dispatch_orders) group by tracking_id having count(*) > 1""",
    ),
    query(
        "ge1_haversine",
        lambda t: rider_legs(t).select("rider_id", F.round(leg(geo.haversine_km), 6).alias("km")),
        f"select rider_id, round({LEG}, 6) as km from legs",
        legs=LEGS_SQL,
    ),
    query(
        "ge2_road_distance",
        lambda t: rider_legs(t).select("rider_id", leg(geo.road_km).alias("km")),
        f"select rider_id, greatest(0.3e0, round({LEG} * 1.28e0, 1)) as km from legs",
        legs=LEGS_SQL,
    ),
    query(
        "ge3_delivery_distance",
        lambda t: destinations(t).select(
            "order_id",
            geo.delivery_km(F.col("latitude"), F.col("longitude"), F.col("dest_lat"), F.col("dest_lng")).alias("km"),
        ),
        f"""select order_id, case when dest_lat is null or dest_lng is null or (dest_lat = 0 and dest_lng = 0) then 5.2e0
        else greatest(0.5e0, round({DEST} * 1.28e0, 1)) end as km from dests""",
        dests=DEST_SQL,
    ),
    query(
        "ge4_route_duration",
        lambda t: t.deliveries.select("order_id", geo.route_minutes(F.col("distance_km")).alias("minutes")),
        "select order_id, greatest(3.0e0, round(distance_km * 2.4e0, 1)) as minutes from deliveries",
    ),
    query(
        "ge5_route_points",
        lambda t: geodata.route_table(rider_legs(t), ["rider_id"]),
        """select rider_id, cast(step as int) as step,
        round(origin_lat + step / 14.0e0 * (dest_lat - origin_lat) - sin(step / 14.0e0 * pi()) * 0.15e0 * (dest_lng - origin_lng), 6) as lat,
        round(origin_lng + step / 14.0e0 * (dest_lng - origin_lng) + sin(step / 14.0e0 * pi()) * 0.15e0 * (dest_lat - origin_lat), 6) as lng
        from legs, range(15) as r(step)""",
        legs=LEGS_SQL,
    ),
    query(
        "ge6_synthetic_drop_off",
        lambda t: destinations(t).select(
            "order_id",
            *[
                c.alias(n)
                for c, n in zip(
                    geo.drop_off_or_synthetic(
                        F.col("latitude"), F.col("longitude"), F.col("dest_lat"), F.col("dest_lng")
                    ),
                    ("lat", "lng"),
                )
            ],
        ),
        """select order_id, case when order_id % 10 in (3, 4) or (dest_lat = 0 and dest_lng = 0) then round(latitude + 0.015e0, 6) else dest_lat end as lat,
        case when order_id % 10 in (3, 4) or (dest_lat = 0 and dest_lng = 0) then round(longitude + 0.012e0, 6) else dest_lng end as lng
        from dests""",
        dests=DEST_SQL,
    ),
    query(
        "ge7_drop_off_at_distance",
        lambda t: destinations(t).select(
            "order_id",
            *[
                F.round(c, 6).alias(n)
                for c, n in zip(
                    geo.drop_off_at_distance(F.col("latitude"), F.col("longitude"), F.col("distance_km")),
                    ("lat", "lng"),
                )
            ],
        ),
        f"""select order_id, round(latitude + distance_km / 111 * {math.cos(0.65)!r}, 6) as lat,
        round(longitude + distance_km / (111 * cos(latitude * pi() / 180)) * {math.sin(0.65)!r}, 6) as lng from dests""",
        dests=DEST_SQL,
    ),
    query(
        "ge8_rider_positions",
        lambda t: geodata.rider_positions(t.riders, t.hotels).select("id", "current_lat", "current_lng", "tracking_source"),
        """select id, case when current_lat <> 0 or current_lng <> 0 then current_lat
          else round(latitude + (('0x' || left(md5(id || '|lat'), 8))::bigint / 4294967296.0e0 - 0.5e0) * 0.015e0, 6) end as current_lat,
        case when current_lat <> 0 or current_lng <> 0 then current_lng
          else round(longitude + (('0x' || left(md5(id || '|lng'), 8))::bigint / 4294967296.0e0 - 0.5e0) * 0.015e0, 6) end as current_lng,
        case when current_lat <> 0 or current_lng <> 0 then 'device' else 'hotel' end as tracking_source
        from riders join hotels using (hotel_id)""",
    ),
    query(
        "ge9_seed_fleet",
        lambda t: geodata.seed_fleet(old_and_new_hotels(t), t.riders, "hotel_name").select(
            "hotel_id", "rider_name", "vehicle_type", "status", "current_lat", "current_lng", "current_address",
            "total_deliveries", "performance_score",
        ),
        """select hotel_id, rider_name, vehicle_type, status, round(latitude + d_lat, 6) as current_lat,
        round(longitude + d_lng, 6) as current_lng, replace(place, '%s', hotel_name) as current_address,
        cast(total as bigint) as total_deliveries, score as performance_score
        from (select hotel_id, hotel_name, latitude, longitude from hotels union all select hotel_id + 1000, hotel_name, latitude, longitude from hotels), (values
          ('Tariq Khan', 'Scooter', 'Available', 0.007e0, 0.005e0, 'Near %s', 18, 94.4e0),
          ('Ali Raza', 'Scooter', 'On Delivery', 0.014e0, 0.011e0, 'En Route from %s', 12, 91.7e0),
          ('Usman Ahmed', 'Car', 'Available', -0.009e0, -0.007e0, 'Station Hub, %s', 25, 100.0e0),
          ('Bilal Shah', 'Bike', 'Offline', 0.002e0, -0.003e0, 'Rest Point, %s', 8, 87.5e0))
          as f(rider_name, vehicle_type, status, d_lat, d_lng, place, total, score)
        where hotel_id not in (select hotel_id from riders where hotel_id is not null)""",
    ),
    query(
        "ge10_resolve_coordinates",
        lambda t: geodata.resolve_coordinates(profiles(t), lookups.country_centroids(t.spark)).select(
            "profile_id", "country", "lat", "lng", "source"
        ),
        RESOLVE_SQL,
        country_rows=COUNTRIES_SQL,
        profile_rows=PROFILES_SQL,
    ),
    query(
        "ge11_address_phrases",
        lambda t: geodata.address_phrases(addresses(t), ["profile_id"], "address"),
        PHRASES_SQL,
        address_rows=ADDRESS_SQL,
    ),
    query(
        "ge11_match_gazetteer",
        lambda t: geodata.match_gazetteer(
            geodata.address_phrases(addresses(t), ["profile_id"], "address"), gazetteer(t), ["profile_id"]
        ),
        """select profile_id, arg_min(phrase, priority) as phrase, arg_min(latitude, priority) as lat,
        arg_min(longitude, priority) as lng from phrase_rows join hotels on lower(phrase) = lower(hotel_name)
        group by profile_id""",
        address_rows=ADDRESS_SQL,
        phrase_rows=PHRASES_SQL,
    ),
    query(
        "ge11_locate_addresses",
        lambda t: geodata.locate_addresses(
            known_and_unknown_addresses(t), ["profile_id"], "address", "country", full_gazetteer(t), lookups.country_centroids(t.spark)
        ),
        """select a.profile_id, m.phrase, coalesce(m.lat, c.lat, 40.7306e0) as lat, coalesce(m.lng, c.lng, -73.9866e0) as lng,
        case when m.phrase is null then 'country' else 'address' end as source
        from located_rows a left join country_rows c on c.country = a.country
        left join (select profile_id, arg_min(phrase, priority) as phrase, arg_min(lat, priority) as lat, arg_min(lng, priority) as lng
          from phrase_rows join place_rows on lower(phrase) = name_key group by profile_id) m on m.profile_id = a.profile_id""",
        address_rows=ADDRESS_SQL,
        located_rows=LOCATED_SQL,
        country_rows=COUNTRIES_SQL,
        phrase_rows=PHRASES_SQL.replace("address_rows", "located_rows"),
        place_rows="""select lower(hotel_name) as name_key, latitude as lat, longitude as lng from hotels
          union all select 'shop 7, harbour street', 1.5e0, 2.5e0""",
    ),
]
