"""JN*, RK*, SO*, AG1-AG4: lookups, listings, set operations and fleet figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from courierflow import domain as D
from courierflow.catalog.base import py_round_sql, query
from courierflow.catalog.features import COUNTRIES_SQL, PROFILES_SQL, hav, profiles
from courierflow.catalog.quality import SPLIT_SQL
from courierflow.operators import assignment, listing, matching, splitting, summaries
from courierflow.functions.scalars import delay_risk
from courierflow.sources import lookups
from courierflow.sources.binding import Tables

# The rider score formula of the ranking oracle.
SCORED_SQL = """
select *, case when total_deliveries > 0 then round(on_time_deliveries * 100.0e0 / total_deliveries, 1) end as performance_score
from riders
"""
RANKED_SQL = """
select hotel_id, id, rider_name, vehicle_type, courier_exp_yrs, km, km / (1 + bonus) as effective_km,
  row_number() over (partition by hotel_id order by km / (1 + bonus), id) as rnk
from (select r.*, round({hav}, 2) as km,
    coalesce(nullif(performance_score, 0), 100.0e0) / 100 * 0.25e0 + coalesce(nullif(rating, 0), 4.8e0) / 5 * 0.15e0 as bonus
  from (select s.*, h.latitude as hlat, h.longitude as hlng,
      coalesce(nullif(current_lat, 0), h.latitude) as rlat, coalesce(nullif(current_lng, 0), h.longitude) as rlng
    from scored_riders s join hotels h using (hotel_id) where lower(status) = 'available') r)
""".replace("{hav}", hav("hlat", "hlng", "rlat", "rlng"))
RANK_CTES = {"scored_riders": SCORED_SQL, "ranked_riders": RANKED_SQL}


def scored_riders(t: Tables):
    share = F.try_divide(F.col("on_time_deliveries") * 100.0, F.col("total_deliveries"))
    return t.riders.withColumn("performance_score", F.round(share, 1))


def couriers(t: Tables):
    return assignment.available_couriers(scored_riders(t), t.hotels)


def notified_orders(t: Tables):
    """Orders whose earlier attempts went to their hotel's first and third courier."""
    per_hotel = (
        assignment.top_couriers(couriers(t), 3)
        .groupBy("hotel_id")
        .agg(
            F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("first_id"),
            F.max(F.when(F.col("rank") == 3, F.col("id"))).alias("third_id"),
        )
    )
    attempts = F.col("dispatch_attempts")
    told = F.array_compact(
        F.array(
            F.when(attempts >= 2, F.col("first_id")), F.when(attempts >= 3, F.col("third_id"))
        )
    )
    return (
        t.dispatch_orders.select("id", "hotel_id", "dispatch_attempts")
        .withColumnRenamed("id", "order_id")
        .join(per_hotel, "hotel_id", "left")
        .select("order_id", "hotel_id", told.alias("notified_rider_ids"))
    )


NOTIFIED_SQL = """
select d.id as order_id, d.hotel_id,
  [x for x in [case when dispatch_attempts >= 2 then a.id end, case when dispatch_attempts >= 3 then c.id end] if x is not null] as notified
from dispatch_orders d left join ranked_riders a on a.hotel_id = d.hotel_id and a.rnk = 1
left join ranked_riders c on c.hotel_id = d.hotel_id and c.rnk = 3
"""


def logged_and_new_orders(t: Tables):
    """All orders, and as many that no log row belongs to."""
    new = t.dispatch_orders.select("id", F.concat(F.lit("NEW-"), "id").alias("tracking_id"))
    return t.dispatch_orders.select("id", "tracking_id").unionByName(new)


def email_log(t: Tables):
    """A log row for every attempt of every order."""
    return t.dispatch_orders.where("dispatch_attempts > 0").select(
        "tracking_id",
        F.explode(F.sequence(F.lit(1), F.col("dispatch_attempts").cast("int"))).alias("attempt"),
        F.col("id"),
    ).select("tracking_id", (F.col("id") * 10 + F.col("attempt")).alias("log_id"), F.lit("SIMULATED").alias("status"))


def hotel_accounts(t: Tables):
    key = F.col("c_custkey")
    return t.customer.select(
        key.alias("id"),
        F.concat(F.lit(" Hotel "), key % 400).alias("hotel_name"),
        F.concat(F.lit("Mail"), key % 300, F.lit("@X.com")).alias("contact_email"),
    )


def account_requests(t: Tables):
    key = F.col("o_orderkey")
    return t.orders.select(
        key.alias("request_id"),
        F.concat(F.lit("hotel "), key * 7 % 600).alias("hotel_name"),
        F.concat(F.lit("mail"), key % 450, F.lit("@x.com ")).alias("email"),
    )


def observed_orders(t: Tables):
    """Dispatch attempts as events, each at a hotel."""
    return t.dispatch_events.select("event_id", (F.col("order_no") % 25).alias("hotel_id"), "ts")


def orders_of_more_hotels(t: Tables):
    """All orders, spread over more hotels than there are profiles."""
    return t.dispatch_orders.select("id", (F.col("id") % 30).alias("hotel_id"))


def model_registry(t: Tables):
    return t.hotels.select(
        "hotel_id", F.concat(F.lit("custom-"), "hotel_id").alias("model_id")
    )


def iso(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def scored_orders(t: Tables):
    return t.dispatch_orders.withColumn("risk_status", delay_risk(F.col("predicted_eta_min")))


def kitchen_rows(t: Tables):
    shown = F.when(F.col("raw_status") == "READY", "Ready").when(
        F.col("raw_status") == "completed", "Completed"
    ).otherwise("Pending")
    tracking = F.concat(F.lit("TRK-"), F.lpad(F.col("order_id").cast("string"), 8, "0"))
    return t.kitchen_queue.withColumns({"status": shown, "tracking_id": tracking})


def completed(t: Tables):
    on_time = F.col("actual_duration_min") <= F.col("predicted_eta_min") + D.ON_TIME_GRACE_MIN
    return t.dispatch_orders.where("dispatch_status = 'Delivered'").withColumn(
        "was_on_time", on_time.cast("int")
    )


COMPLETED_SQL = """
select *, cast(actual_duration_min <= predicted_eta_min + 2 as int) as was_on_time
from dispatch_orders where dispatch_status = 'Delivered'
"""

NEWEST_ITEM = ["order_id", "line_no", "item_id", "station_id", "quantity", "unit_price"]

WEATHER_SQL = """select event_id, p.hotel_id, w.obs_id, case when windspeed >= 28 then 'Windy' when weathercode in (45,48) then 'Foggy'
        when weathercode in (51,53,55,56,57,61,63,65,66,67,80,81,82,95,96,99) then 'Rainy'
        when weathercode in (71,73,75,77,85,86) then 'Snowy' else 'Clear' end as weather_now
        from (select event_id, order_no % 25 as hotel_id, ts from dispatch_events) p
        asof left join (select hotel_id, obs_ts, arg_max(weathercode, obs_id) as weathercode, arg_max(windspeed, obs_id) as windspeed,
          max(obs_id) as obs_id from weather_obs group by hotel_id, obs_ts) w on w.hotel_id = p.hotel_id and w.obs_ts <= p.ts"""

QUERIES = [
    query(
        "jn1_hotel_defaults",
        lambda t: matching.with_hotel_defaults(
            orders_of_more_hotels(t), t.hotels
        ).select("id", "hotel_name", "hotel_address", "hotel_lat", "hotel_lng", "hotel_prep_min", "hotel_vehicle"),
        """select id, coalesce(h.hotel_name, 'Express Hub') as hotel_name, 'Dispatch Origin' as hotel_address,
        coalesce(nullif(latitude, 0), 40.7306e0) as hotel_lat, coalesce(nullif(longitude, 0), -73.9866e0) as hotel_lng,
        coalesce(nullif(default_prep_time_min, 0), 15.0e0) as hotel_prep_min, coalesce(default_vehicle_type, 'Scooter') as hotel_vehicle
        from (select id, id % 30 as hotel_id from dispatch_orders) d left join hotels h on d.hotel_id = h.hotel_id""",
    ),
    query(
        "jn2_nearest_courier",
        lambda t: assignment.assign_nearest(t.dispatch_orders.select("id", "hotel_id"), couriers(t)).select(
            "id",
            "hotel_id",
            F.col("rider.rider_id").alias("rider_id"),
            F.col("rider.distance_to_hotel_km").alias("km"),
            F.round("rider.effective_km", 6).alias("effective_km"),
        ),
        """select d.id, d.hotel_id, r.id as rider_id, r.km, round(r.effective_km, 6) as effective_km
        from dispatch_orders d left join ranked_riders r on r.hotel_id = d.hotel_id and r.rnk = 1""",
        **RANK_CTES,
    ),
    query(
        "jn3_exclude_notified",
        lambda t: assignment.next_courier(notified_orders(t), couriers(t)).select(
            "order_id",
            F.size("notified_rider_ids").alias("notified"),
            F.col("next_rider.rider_id").alias("rider_id"),
        ),
        """select order_id, cast(len(notified) as int) as notified, rider_id from (
        select o.order_id, any_value(o.notified) as notified, arg_min(r.id, r.rnk) as rider_id
        from notified_orders o left join ranked_riders r on r.hotel_id = o.hotel_id and not list_contains(o.notified, r.id)
        group by o.order_id)""",
        **RANK_CTES,
        notified_orders=NOTIFIED_SQL,
    ),
    query(
        "jn4_audit_trail",
        lambda t: matching.with_audit_trail(logged_and_new_orders(t), email_log(t)),
        """select d.id, d.tracking_id, l.log_id, l.status from (select id, tracking_id from dispatch_orders
          union all select id, 'NEW-' || id from dispatch_orders) d left join (
        select tracking_id, id * 10 + a as log_id, 'SIMULATED' as status
        from dispatch_orders, range(1, 1 + (select max(dispatch_attempts) from dispatch_orders)::bigint) as v(a)
        where dispatch_attempts >= a) l on l.tracking_id = d.tracking_id""",
    ),
    query(
        "jn5_assigned_rider",
        lambda t: matching.with_assigned_rider(t.dispatch_orders.select("id", "assigned_rider_id"), t.riders),
        """select d.id, assigned_rider_id, rider_name, r.vehicle_type as rider_vehicle, rating, status as rider_status
        from dispatch_orders d left join riders r on r.id = d.assigned_rider_id""",
    ),
    query(
        "jn6_point_lookups",
        lambda t: matching.lookup(
            t.dispatch_orders.select("id", "tracking_id", "dispatch_status"),
            t.dispatch_events.select(
                F.concat(F.lit(" TRK-"), F.lpad(F.col("order_no").cast("string"), 8, "0")).alias("tracking_id")
            ),
            "tracking_id",
        ),
        """select id, tracking_id, dispatch_status from dispatch_orders
        where tracking_id in (select 'TRK-' || lpad(cast(order_no as varchar), 8, '0') from dispatch_events)""",
    ),
    query(
        "jn7_match_profiles",
        lambda t: matching.match_profiles(account_requests(t), hotel_accounts(t)).select(
            "request_id", "profile_id", "matched_on"
        ),
        """select request_id, coalesce(b.id, e.id, n.id) as profile_id,
        case when b.id is not null then 'email_and_name' when e.id is not null then 'email' when n.id is not null then 'name' end as matched_on
        from (select o_orderkey as request_id, 'hotel ' || (o_orderkey * 7 % 600) as name, 'mail' || (o_orderkey % 450) || '@x.com' as email from orders) q
        left join (select name, email, max(id) as id from accounts group by 1, 2) b on b.name = q.name and b.email = q.email
        left join (select email, max(id) as id from accounts group by 1) e on e.email = q.email
        left join (select name, max(id) as id from accounts group by 1) n on n.name = q.name""",
        accounts="select c_custkey as id, 'hotel ' || (c_custkey % 400) as name, 'mail' || (c_custkey % 300) || '@x.com' as email from customer",
    ),
    query(
        "jn8_country_centroid",
        lambda t: matching.with_centroid(
            profiles(t).select("profile_id", "country"), lookups.country_centroids(t.spark)
        ),
        """select profile_id, p.country, coalesce(c.lat, 40.7306e0) as centroid_lat, coalesce(c.lng, -73.9866e0) as centroid_lng
        from profile_rows p left join country_rows c on c.country = p.country""",
        country_rows=COUNTRIES_SQL,
        profile_rows=PROFILES_SQL,
    ),
    query(
        "jn9_weather_in_force",
        lambda t: matching.with_weather_in_force(observed_orders(t), t.weather_obs, "ts").select(
            "event_id", "hotel_id", "obs_id", "weather_now"
        ),
        WEATHER_SQL,
    ),
    query(
        "jn10_choose_model",
        lambda t: matching.choose_models(orders_of_more_hotels(t), model_registry(t)),
        """select id, id % 30 as hotel_id, coalesce('custom-' || h.hotel_id, 'default') as model_id
        from dispatch_orders left join hotels h on h.hotel_id = id % 30""",
    ),
    query(
        "ag1_fleet_stats",
        lambda t: summaries.fleet_stats(t.riders, t.hotels),
        f"""select h.hotel_id, count(r.id) as total_riders, count(*) filter (lower(status) = 'available') as available_riders,
        count(*) filter (lower(status) = 'on delivery') as on_delivery_riders, count(*) filter (lower(status) = 'offline') as offline_riders,
        coalesce({py_round_sql("avg(courier_exp_yrs)", 1)}, 0.0e0) as avg_experience_yrs
        from hotels h left join riders r on r.hotel_id = h.hotel_id group by h.hotel_id""",
    ),
    query(
        "ag2_batch_kpis",
        lambda t: summaries.batch_kpis(scored_orders(t), "predicted_eta_min", ["hotel_id"]),
        f"""select hotel_id, count(*) as total_orders, {py_round_sql("avg(predicted_eta_min)", 2)} as avg_delivery_time_min,
        round(min(predicted_eta_min), 2) as min_delivery_time_min, round(max(predicted_eta_min), 2) as max_delivery_time_min,
        count(*) filter (predicted_eta_min > 50) as high_risk_count, count(*) filter (predicted_eta_min <= 35) as fast_delivery_count
        from dispatch_orders group by hotel_id""",
    ),
    query(
        "ag3_history_counts",
        lambda t: summaries.history_counts(t.dispatch_orders),
        "select hotel_id, count(*) as records from dispatch_orders group by hotel_id",
    ),
    query(
        "ag4_rider_performance",
        lambda t: summaries.rider_performance(t.riders, completed(t)).select(
            "id", "total_deliveries", "on_time_deliveries", "performance_score"
        ),
        f"""select id, total_deliveries, on_time_deliveries, case when total_deliveries > 0
          then {py_round_sql("(on_time_deliveries / total_deliveries * 100.0e0)", 1)} else 100.0e0 end as performance_score
        from (select r.id, r.total_deliveries + coalesce(n, 0) as total_deliveries, r.on_time_deliveries + coalesce(o, 0) as on_time_deliveries
          from riders r left join (select assigned_rider_id, count(*) as n, cast(sum(was_on_time) as bigint) as o
            from completed_rows group by 1) c on c.assigned_rider_id = r.id)""",
        completed_rows=COMPLETED_SQL,
    ),
    query(
        "rk1_recent_predictions",
        lambda t: listing.recent(
            scored_orders(t).select("id", "hotel_id", "predicted_eta_min", "risk_status"),
            [F.desc("id")],
            limit=20,
            offset=10,
            where=F.col("hotel_id") == 3,
        ),
        """select id, hotel_id, predicted_eta_min, case when predicted_eta_min <= 35 then 'Fast / Low Risk'
        when predicted_eta_min <= 50 then 'Standard / Medium Risk' else 'High Delay Risk' end as risk_status
        from dispatch_orders where hotel_id = 3 order by id desc limit 20 offset 10""",
    ),
    query(
        "rk2_recent_dispatches",
        lambda t: listing.recent_per_group(
            t.dispatch_orders.select("id", "hotel_id", "dispatch_status"), "hotel_id", F.desc("id"), 50
        ),
        """select id, hotel_id, dispatch_status, cast(recency as int) as recency from (select id, hotel_id, dispatch_status,
        row_number() over (partition by hotel_id order by id desc) as recency from dispatch_orders) where recency <= 50""",
    ),
    query(
        "rk3_latest_profile",
        lambda t: listing.latest_row(
            t.dispatch_orders.select("id", "hotel_id", "created_at"), ["created_at", "id"]
        ).select("id", "hotel_id", iso("created_at")),
        """select id, hotel_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at
        from dispatch_orders order by dispatch_orders.created_at desc, id desc limit 1""",
    ),
    query(
        "rk4_riders_by_status",
        lambda t: listing.riders_with_status(t.riders, None, "AVAILABLE")
        .select("id", "hotel_id", "rider_name", "status")
        .orderBy("id"),
        "select id, hotel_id, rider_name, status from riders where lower(status) = 'available' order by id",
    ),
    query(
        "rk5_kitchen_listing",
        lambda t: listing.kitchen_listing(
            kitchen_rows(t), [F.desc(c) for c in NEWEST_ITEM], statuses="ready, COMPLETED", limit=100
        ).select(*NEWEST_ITEM, "status"),
        """select order_id, line_no, item_id, station_id, quantity, unit_price, case raw_status when 'READY' then 'Ready' else 'Completed' end as status
        from kitchen_queue where raw_status in ('READY', 'completed')
        order by order_id desc, line_no desc, item_id desc, station_id desc, quantity desc, unit_price desc limit 100""",
    ),
    query(
        "rk6_preview",
        lambda t: listing.preview(
            t.deliveries.select("order_id", "weather", "traffic_level", "time_of_day", "vehicle_type"), [F.asc("order_id")]
        ),
        """select cast(order_id as varchar) as order_id, coalesce(weather, '') as weather, coalesce(traffic_level, '') as traffic_level,
        coalesce(time_of_day, '') as time_of_day, vehicle_type from deliveries order by deliveries.order_id limit 10""",
    ),
    query(
        "rk7_rank_couriers",
        lambda t: assignment.rank_couriers(couriers(t)).select(
            "hotel_id", "id", "rank", F.round("effective_km", 6).alias("effective_km")
        ),
        "select hotel_id, id, rnk as rank, round(effective_km, 6) as effective_km from ranked_riders",
        **RANK_CTES,
    ),
    query(
        "rk9_keep_last",
        lambda t: listing.keep_last(
            t.dispatch_events.select("rider_id", "event_id", "action", "value"), ["rider_id"], "event_id"
        ),
        """select rider_id, event_id, action, value from dispatch_events
        qualify row_number() over (partition by rider_id order by event_id desc) = 1""",
    ),
    query(
        "rk10_training_extract",
        lambda t: listing.training_extract(t.dispatch_orders).withColumn(
            "created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
        ),
        """select id, tracking_id, distance_km, weather, traffic_level, time_of_day, vehicle_type, prep_time_min, courier_exp_yrs,
        predicted_eta_min, actual_duration_min, actual_duration_min as actual_delivery_minutes, predicted_eta_min as predicted_eta_minutes,
        prep_time_min as preparation_time_min, courier_exp_yrs as courier_experience_yrs, dispatch_status,
        strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at from dispatch_orders where dispatch_status = 'Delivered'""",
    ),
    query(
        "so1_stack_splits",
        lambda t: (
            lambda rows: listing.stack_rows(
                rows.where("split = 'train'").select("order_id", "split", "weather"),
                rows.where("split = 'test'").select("order_id", "split", "vehicle_type"),
            )
        )(splitting.with_split(t.deliveries)),
        """select order_id, split, case when split = 'train' then weather end as weather,
        case when split = 'test' then vehicle_type end as vehicle_type from split_rows""",
        split_rows=SPLIT_SQL,
    ),
    query(
        "so2_key_overlap",
        lambda t: listing.key_overlap(
            t.dispatch_orders.select(F.col("id").alias("k")), t.dispatch_events.select(F.col("order_no").alias("k")), "k"
        ),
        """select coalesce(a.k, b.k) as k, case when a.k is null then 'right_only' when b.k is null then 'left_only' else 'both' end as found
        from (select distinct id as k from dispatch_orders) a full join (select distinct order_no as k from dispatch_events) b on a.k = b.k""",
    ),
]
