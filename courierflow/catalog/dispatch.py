"""DS*, MU1-MU4, AG5, ST4: dispatch, mutations and ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from courierflow import domain as D
from courierflow.catalog.base import py_round_sql, query
from courierflow.catalog.features import hav
from courierflow.catalog.learning import trained
from courierflow.catalog.lookups import NOTIFIED_SQL, RANK_CTES, couriers, notified_orders, scored_riders
from courierflow.operators import dispatch, mutations, ratings
from courierflow.plans import dispatching
from courierflow.session import work_path
from courierflow.sources import segments
from courierflow.sources.binding import Tables
from courierflow.streaming.positions import apply_snapshot, merge_reduced, reduce_events

AS_OF = "1998-06-30 00:00:00"
FORMAT = "yyyy-MM-dd HH:mm:ss"


def shown(column: str):
    return F.date_format(column, FORMAT).alias(column)


def text_ts(column: str, alias: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') as {alias or column}"


def open_orders(t: Tables):
    """Dispatch orders with the couriers told so far."""
    base = t.dispatch_orders.select(
        F.col("id").alias("order_id"), "tracking_id", "assigned_rider_id", "dispatch_attempts",
        "dispatch_status", "token_expires_at", "created_at",
    )
    return base.join(notified_orders(t), "order_id")


def cascaded(t: Tables):
    expired = dispatch.timed_out(open_orders(t), AS_OF)
    return dispatch.cascade(expired, couriers(t), AS_OF, dispatch.TIMED_OUT)


OPEN_SQL = """
select d.id as order_id, d.hotel_id, tracking_id, assigned_rider_id, dispatch_attempts, dispatch_status, token_expires_at, d.created_at,
  case when list_contains(notified, assigned_rider_id) then notified else list_append(notified, assigned_rider_id) end as told
from dispatch_orders d join notified_orders n on n.order_id = d.id
where dispatch_status = 'Pending_Rider' and token_expires_at <= timestamp '1998-06-30 00:00:00'
"""
CASCADED_SQL = """
select o.*, next_id from open_rows o left join (
  select o.order_id, arg_min(r.id, r.rnk) as next_id from open_rows o
  join ranked_riders r on r.hotel_id = o.hotel_id and not list_contains(told, r.id) group by o.order_id) p using (order_id)
"""
CASCADE_CTES = {**RANK_CTES, "notified_orders": NOTIFIED_SQL, "open_rows": OPEN_SQL, "cascaded_rows": CASCADED_SQL}


def activation_requests(t: Tables):
    """Activation clicks; each falls some minutes after its order was created."""
    clicks = t.dispatch_events.where("action in ('ACTIVATE', 'LOCATION')")
    late = F.make_dt_interval(mins=(F.col("event_id") % 9).cast("int"))
    return clicks.join(
        t.dispatch_orders.select(F.col("id").alias("order_no"), "created_at"), "order_no"
    ).select(F.col("order_no").alias("order_id"), "event_id", (F.col("created_at") + late).alias("ts"))


def dispatched(t: Tables):
    return t.dispatch_orders.withColumnRenamed("id", "order_id")


REQUESTS_SQL = """
select order_no as order_id, event_id, created_at + to_minutes(cast(event_id % 9 as int)) as ts
from dispatch_events join dispatch_orders on id = order_no where action in ('ACTIVATE', 'LOCATION')
"""
OUTCOMES_SQL = """
select r.order_id, r.event_id, r.ts, d.assigned_rider_id, d.tracking_id, case when dispatch_status = 'Active' then 'already_active'
  when dispatch_status <> 'Pending_Rider' then 'already_' || lower(dispatch_status)
  when first_ts >= token_expires_at then case when is_first then 'expired' else 'invalid_token' end
  when is_first then 'activated' else 'already_active' end as outcome
from (select *, row_number() over (partition by order_id order by ts, event_id) = 1 as is_first,
  min(ts) over (partition by order_id) as first_ts from request_rows) r join dispatch_orders d on d.id = r.order_id
"""


TOLD_SQL = """
select d.id as order_id, d.hotel_id, assigned_rider_id, dispatch_attempts, {at} as moved_at,
  case when list_contains(notified, assigned_rider_id) then notified else list_append(notified, assigned_rider_id) end as told
from dispatch_orders d join notified_orders n on n.order_id = d.id join ({why}) w on w.order_id = d.id
where dispatch_status = 'Pending_Rider'
"""
DECLINED_SQL = TOLD_SQL.format(
    at="declined_at",
    why="select order_no as order_id, min(ts) as declined_at from dispatch_events where action = 'DEACTIVATE' group by 1",
)
CLICKED_SQL = TOLD_SQL.format(at="ts", why="select order_id, ts from outcome_rows where outcome = 'expired'")
CASCADE_RESULT_SQL = """
select order_id, case when next_id is null then 'CASCADE_EXHAUSTED' else '{kind}' end as event_type,
  coalesce(next_id, assigned_rider_id) as assigned_rider_id, dispatch_attempts + cast(next_id is not null as int) as dispatch_attempts,
  case when next_id is null then 'Unassigned_No_Riders' else 'Pending_Rider' end as dispatch_status,
  strftime(moved_at, '%Y-%m-%d %H:%M:%S') as moved_at from {rows}
"""


def declined(t: Tables):
    """Offers that couriers decline: their orders move on at the first decline in the log."""
    declines = t.dispatch_events.where("action = 'DEACTIVATE'").groupBy(F.col("order_no").alias("order_id"))
    at = declines.agg(F.min("ts").alias("declined_at"))
    pending = open_orders(t).where(F.col("dispatch_status") == D.PENDING)
    return dispatch.cascade(pending.join(at, "order_id"), couriers(t), F.col("declined_at"), dispatch.DECLINED)


def shown_cascade(moved):
    return moved.select(
        "order_id", "event_type", "assigned_rider_id", "dispatch_attempts", "dispatch_status",
        F.date_format("updated_at", FORMAT).alias("moved_at"),
    )


def completions(t: Tables):
    """Active and pending orders completed 4 to 94 minutes after creation; some tell their duration."""
    key = F.col("order_id")
    after = F.make_dt_interval(secs=((key * 37 % 5400) + 240).cast("decimal(18,6)"))
    return dispatched(t).where("dispatch_status <> 'Delivered'").select(
        "order_id",
        (F.col("created_at") + after).alias("completed_at"),
        F.when(key % 4 == 0, (key % 80).cast("double")).alias("given_duration_min"),
    )


def completed(t: Tables):
    orders = dispatched(t).withColumn(
        "activated_at",
        F.when(F.col("order_id") % 3 == 0, F.col("created_at") + F.make_dt_interval(mins=F.lit(3))),
    )
    return dispatch.complete(orders, completions(t))


_ELAPSED = "(epoch_us(completed_at) - epoch_us(coalesce(activated_at, created_at)))::double / 6e7"
COMPLETED_SQL = f"""
select *, cast(actual <= predicted_eta_min + 2 as int) as was_on_time from (
  select *, coalesce(case when id % 4 = 0 then cast(id % 80 as double) end, greatest(1.0e0, {py_round_sql('minutes', 1)})) as actual
  from (select *, {_ELAPSED} as minutes from (
    select *, case when id % 3 = 0 then created_at + interval 3 minute end as activated_at,
      created_at + to_seconds(cast(id * 37 % 5400 + 240 as int)) as completed_at
    from dispatch_orders where dispatch_status <> 'Delivered')))
"""


def dispatch_requests(t: Tables):
    """Orders triggered in the event log, with drop-offs around their hotels and gaps."""
    key = F.col("event_id")
    at = t.hotels.select("hotel_id", "latitude", "longitude")
    offset = (key % 401 - 200).cast("double") / 10000
    return (
        t.dispatch_events.where("action = 'DISPATCH_TRIGGERED'")
        .withColumn("hotel_id", F.floor(key / 5) % 30)
        .join(at, "hotel_id", "left")
        .select(
            key.alias("order_id"),
            "hotel_id",
            F.col("ts").alias("created_at"),
            F.when(key % 3 == 0, F.concat(F.lit(" TRK-E"), key)).alias("tracking_id"),
            F.when(key % 20 != 0, F.round(F.col("latitude") + offset, 6)).alias("dest_lat"),
            F.when(key % 20 != 0, F.round(F.col("longitude") - offset, 6)).alias("dest_lng"),
            F.when(key % 4 == 0, F.lit("Car")).alias("vehicle_type"),
            F.when(key % 6 != 0, (key % 40).cast("double")).alias("prep_time_min"),
            F.when(key % 7 == 0, "High").when(key % 7 == 1, "").when(key % 7 == 2, "Low").alias("traffic_level"),
        )
    )


def new_dispatches(t: Tables, estimate=dispatching.estimate_fallback):
    made = dispatching.create_dispatches(
        dispatch_requests(t), t.hotels, couriers(t), t.weather_obs, estimate
    )
    return shown_dispatches(made)


def shown_dispatches(made):
    return made.select(
        "order_id", "hotel_id", "tracking_id", "dest_lat", "dest_lng", *D.RAW_FEATURES,
        "predicted_eta_min", "assigned_rider_id", "dispatch_status", shown("token_expires_at"),
    )


DISPATCH_KM = "case when dlat is null then 5.2e0 else greatest(0.5e0, round({} * 1.28e0, 1)) end".format(
    hav("hlat", "hlng", "dlat", "dlng")
)
NEW_DISPATCH_SQL = f"""
select order_id, hotel_id, tracking_id, dlat as dest_lat, dlng as dest_lng, km as distance_km, weather, traffic_level, time_of_day, vehicle_type,
  preparation_time_min, courier_experience_yrs, {py_round_sql('(15 + km * 2.5e0)', 1)} as predicted_eta_min, rider_id as assigned_rider_id,
  case when rider_id is null then 'Unassigned_No_Riders' else 'Pending_Rider' end as dispatch_status,
  {text_ts("created_at + interval 5 minute", "token_expires_at")}
from (select *, {DISPATCH_KM} as km from (
  select q.order_id, q.hotel_id, q.created_at, q.hlat, q.hlng, coalesce(q.dest_lat, round(q.hlat + 0.015e0, 6)) as dlat,
    coalesce(q.dest_lng, round(q.hlng + 0.012e0, 6)) as dlng,
    case when q.order_id % 3 = 0 then 'TRK-E' || q.order_id else 'TRK-' || upper(left(sha256(q.order_id || '|42'), 32)) end as tracking_id,
    case when windspeed >= 28 then 'Windy' when weathercode in (45,48) then 'Foggy'
      when weathercode in (51,53,55,56,57,61,63,65,66,67,80,81,82,95,96,99) then 'Rainy'
      when weathercode in (71,73,75,77,85,86) then 'Snowy' else 'Clear' end as weather,
    case q.order_id % 7 when 0 then 'High' when 2 then 'Low' else 'Medium' end as traffic_level,
    case when hour(q.created_at) between 5 and 11 then 'Morning' when hour(q.created_at) between 12 and 16 then 'Afternoon'
      when hour(q.created_at) between 17 and 21 then 'Evening' else 'Night' end as time_of_day,
    coalesce(r.vehicle_type, case when q.order_id % 4 = 0 then 'Car' end, default_vehicle_type, 'Scooter') as vehicle_type,
    coalesce(case when q.order_id % 6 <> 0 then cast(q.order_id % 40 as double) end, default_prep_time_min, 15.0e0) as preparation_time_min,
    coalesce(nullif(r.courier_exp_yrs, 0), 2.5e0) as courier_experience_yrs, r.id as rider_id
  from (select event_id as order_id, (event_id // 5) % 30 as hotel_id, ts as created_at,
      coalesce(nullif(latitude, 0), 40.7306e0) as hlat, coalesce(nullif(longitude, 0), -73.9866e0) as hlng, default_vehicle_type, default_prep_time_min,
      case when event_id % 20 <> 0 then round(latitude + cast(event_id % 401 - 200 as double) / 10000, 6) end as dest_lat,
      case when event_id % 20 <> 0 then round(longitude - cast(event_id % 401 - 200 as double) / 10000, 6) end as dest_lng
    from dispatch_events left join hotels h on h.hotel_id = (event_id // 5) % 30 where action = 'DISPATCH_TRIGGERED') q
  left join ranked_riders r on r.hotel_id = q.hotel_id and r.rnk = 1
  asof left join (select hotel_id, obs_ts, arg_max(weathercode, obs_id) as weathercode, arg_max(windspeed, obs_id) as windspeed
    from weather_obs group by hotel_id, obs_ts) w on w.hotel_id = q.hotel_id and w.obs_ts <= q.created_at))
"""


def rating_events(t: Tables):
    on_time = F.col("actual_duration_min") <= F.col("predicted_eta_min") + D.ON_TIME_GRACE_MIN
    return t.dispatch_orders.where("dispatch_status = 'Delivered'").select(
        F.col("assigned_rider_id").alias("rider_id"), F.col("created_at").alias("ts"), "id", on_time.cast("int").alias("was_on_time")
    )


def rider_events(t: Tables):
    """Position pushes and status changes of the riders of the log."""
    key = F.col("event_id")
    return t.dispatch_events.where("action in ('LOCATION', 'STATUS')").select(
        (F.col("rider_id") % 120).alias("rider_id"),
        "ts",
        "event_id",
        F.when(F.col("action") == "LOCATION", F.round(F.col("value") / 10, 4)).alias("lat"),
        F.when(F.col("action") == "LOCATION", F.round(F.col("value") / 7, 4)).alias("lng"),
        F.when(key % 3 == 0, F.concat(F.lit("Stop "), key)).alias("address"),
        F.when(F.col("action") == "STATUS", F.when(key % 2 == 0, " Available ").otherwise("Busy")).alias("status"),
    )


def addressed_riders(t: Tables):
    return t.riders.select(
        "id", "hotel_id", "status", "current_lat", "current_lng", F.concat(F.lit("Home "), "id").alias("current_address")
    )


def positions(t: Tables):
    moved = mutations.latest_positions(addressed_riders(t), rider_events(t))
    return moved.withColumn("last_active_at", F.date_format("last_active_at", FORMAT))


def compacted_positions(t: Tables):
    """The same from ten batches of events, kept in segments that are merged by threes."""
    path = work_path(t.spark, "positions")
    events = rider_events(t)
    for number in range(10):
        batch = events.where(F.pmod("event_id", F.lit(10)) == number)
        segments.append(reduce_events(batch), path, number, merge_reduced, fan=3)
    moved = apply_snapshot(addressed_riders(t), segments.read(t.spark, path, 10, merge_reduced, fan=3))
    return moved.withColumn("last_active_at", F.date_format("last_active_at", FORMAT))


POSITIONS_SQL = f"""
select r.id, r.hotel_id, coalesce(st, r.status) as status, coalesce(lat, r.current_lat) as current_lat, coalesce(lng, r.current_lng) as current_lng,
  coalesce(address, 'Home ' || r.id) as current_address, {text_ts('last_ts', 'last_active_at')}
from riders r left join (select rider_id % 120 as id,
    arg_max(round(value / 10, 4), (ts, event_id)) filter (action = 'LOCATION') as lat,
    arg_max(round(value / 7, 4), (ts, event_id)) filter (action = 'LOCATION') as lng,
    arg_max('Stop ' || event_id, (ts, event_id)) filter (event_id % 3 = 0) as address,
    arg_max(case when event_id % 2 = 0 then 'Available' else 'Busy' end, (ts, event_id)) filter (action = 'STATUS') as st, max(ts) as last_ts
  from dispatch_events where action in ('LOCATION', 'STATUS') group by 1) e on e.id = r.id
"""


def account_table(t: Tables):
    key = F.col("c_custkey")
    return t.customer.select(
        key.alias("id"),
        F.col("c_name").alias("hotel_name"),
        F.concat(F.lit("m"), key, F.lit("@x.com")).alias("contact_email"),
        F.concat(F.lit("secret"), key).alias("access_key"),
    )


def account_changes(t: Tables):
    """Changes by id, by email, and of unknown profiles; some leave the key blank."""
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        F.when(key % 2 == 0, who).alias("id"),
        F.concat(F.lit("Renamed "), key).alias("hotel_name"),
        F.when(key % 5 == 0, F.concat(F.lit("new"), key, F.lit("@y.com")))
        .otherwise(F.concat(F.lit(" M"), who, F.lit("@x.com")))
        .alias("contact_email"),
        F.when(key % 4 == 0, F.concat(F.lit("k"), key)).otherwise("").alias("access_key"),
        F.lit(False).alias("deleted"),
        key.alias("seq"),
    )


def merged_accounts(t: Tables):
    current = account_table(t)
    changes = mutations.resolve_profile_ids(account_changes(t), current)
    return mutations.merge_snapshot(current, changes, "id", "seq", ("access_key",))


ACCOUNT_CHANGES_SQL = """
select coalesce(case when o_orderkey % 2 = 0 then o_custkey end, case when o_orderkey % 5 <> 0 then c_custkey end,
    ('0x' || left(md5('new' || o_orderkey || '@y.com|Renamed ' || o_orderkey || '|profile'), 15))::bigint) as id,
  'Renamed ' || o_orderkey as hotel_name,
  case when o_orderkey % 5 = 0 then 'new' || o_orderkey || '@y.com' else ' M' || o_custkey || '@x.com' end as contact_email,
  case when o_orderkey % 4 = 0 then 'k' || o_orderkey end as access_key, o_orderkey as seq
from orders left join customer on c_custkey = o_custkey
"""
MERGED_SQL = """
select coalesce(c.id, n.id) as id, coalesce(n.hotel_name, c.hotel_name) as hotel_name, coalesce(n.contact_email, c.contact_email) as contact_email,
  coalesce(n.access_key, c.access_key) as access_key
from (select c_custkey as id, c_name as hotel_name, 'm' || c_custkey || '@x.com' as contact_email, 'secret' || c_custkey as access_key from customer) c
full join (select id, arg_max(hotel_name, seq) as hotel_name, arg_max(contact_email, seq) as contact_email,
  arg_max(access_key, seq) filter (access_key is not null) as access_key from account_changes group by id) n on n.id = c.id
"""


def rider_table(t: Tables):
    return t.riders.select("id", "hotel_id", "rider_name", "vehicle_type", "rating")


def rider_changes(t: Tables):
    """Edits, hires and departures taken from the event log."""
    key = F.col("event_id")
    return t.dispatch_events.select(
        (F.col("rider_id") % 160).alias("id"),
        (key % 25).alias("hotel_id"),
        F.concat(F.lit("Rider "), key).alias("rider_name"),
        F.when(key % 2 == 0, "Bike").otherwise("Car").alias("vehicle_type"),
        (F.lit(40) + key % 11).cast("double").alias("rating"),
        (F.col("action") == "STATUS").alias("deleted"),
        key.alias("seq"),
    )


def history_rows(t: Tables):
    return t.deliveries.select(
        F.when(F.col("order_id") % 50 != 0, F.col("hotel_id")).alias("hotel_id"),
        F.concat(F.lit("ORD-"), "order_id").alias("order_reference"),
        "distance_km", "weather", "traffic_level", "time_of_day", "vehicle_type", "preparation_time_min", "courier_experience_yrs",
        (F.lit(12.0) + F.col("distance_km") * 3.0 + F.col("preparation_time_min")).alias("minutes"),
    )


_MIN = "(12 + distance_km * 3.0e0 + preparation_time_min)"
HISTORY_SQL = f"""
select coalesce(case when order_id % 50 <> 0 then hotel_id end, 1) as hotel_id, 'ORD-' || order_id as order_reference, distance_km,
  coalesce(weather, 'Clear') as weather, coalesce(traffic_level, 'Medium') as traffic_level, coalesce(time_of_day, 'Evening') as time_of_day,
  vehicle_type, preparation_time_min as prep_time_min, coalesce(courier_experience_yrs, 3.0e0) as courier_exp_yrs,
  {py_round_sql(_MIN, 2)} as predicted_time_min, case when {_MIN} <= 35 then 'Fast / Low Risk' when {_MIN} <= 50 then 'Standard / Medium Risk'
    else 'High Delay Risk' end as risk_status, 'batch' as source_type from deliveries
"""


def audit_trail(t: Tables):
    """Events of creation, timeouts, activations and completions."""
    named = dispatched(t).join(t.riders.select(F.col("id").alias("assigned_rider_id"), "rider_name"), "assigned_rider_id", "left")
    outcomes = dispatch.activation_outcomes(dispatched(t), activation_requests(t))
    parts = [
        dispatch.created_events(named),
        dispatch.cascade_events(cascaded(t), dispatch.TIMED_OUT),
        dispatch.activated_events(dispatch.apply_activations(dispatched(t), outcomes)),
        dispatch.completed_events(completed(t)),
    ]
    trail = parts[0]
    for part in parts[1:]:
        trail = trail.unionByName(part)
    return trail


AUDIT_SQL = f"""
select id as order_id, tracking_id, assigned_rider_id as rider_id, 'DISPATCH_TRIGGERED' as event_type,
  '{{"assigned_rider":"' || coalesce(r.rider_name, '') || '"}}' as details, {text_ts('d.created_at', 'created_at')}
from dispatch_orders d left join (select id as rid, rider_name from riders) r on rid = assigned_rider_id
union all
select order_id, tracking_id, assigned_rider_id, case when next_id is null then 'CASCADE_EXHAUSTED' else 'TIMEOUT_EXPIRED' end,
  case when next_id is null then '{{"message":"All couriers notified or unavailable","reason":"5_minute_timeout"}}'
    else '{{"dropped_rider":' || assigned_rider_id || ',"cascaded_to":' || next_id || ',"reason":"5_minute_timeout"}}' end, '{AS_OF}' from cascaded_rows
union all
select order_id, tracking_id, assigned_rider_id, 'ORDER_ACTIVATED', '{{"activated_at":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '"}}',
  strftime(ts, '%Y-%m-%d %H:%M:%S') from outcome_rows where outcome = 'activated'
union all
select id, tracking_id, assigned_rider_id, 'ORDER_COMPLETED', '{{"actual_duration_min":' || actual || ',"predicted_eta_min":' || predicted_eta_min
  || ',"was_on_time":' || case was_on_time when 1 then 'true' else 'false' end || '}}', strftime(completed_at, '%Y-%m-%d %H:%M:%S') from completed_rows
"""


def offers(t: Tables):
    riders = t.riders.select(
        F.col("id").alias("assigned_rider_id"),
        "rider_name",
        F.when(F.col("id") % 2 == 0, F.concat(F.lit(" r"), "id", F.lit("@mail.com"))).alias("rider_email"),
    )
    return dispatched(t).join(riders, "assigned_rider_id")


QUERIES = [
    query("ds1_create_dispatches", new_dispatches, NEW_DISPATCH_SQL, **RANK_CTES),
    query(
        "ds1_create_with_model",
        lambda t: new_dispatches(t, dispatching.estimate_with(trained(t)[1])),
    ),
    query(
        "ds1_model_dispatches",
        lambda t: new_dispatches(t, dispatching.estimate_with(trained(t)[1])).withColumn(
            "predicted_eta_min", F.col("predicted_eta_min").between(0, 300)
        ),
        f"select * replace (true as predicted_eta_min) from ({NEW_DISPATCH_SQL})",
        **RANK_CTES,
    ),
    query(
        "ds2_timed_out",
        lambda t: dispatch.timed_out(dispatched(t), AS_OF).select("order_id", "hotel_id", shown("token_expires_at")),
        f"""select id as order_id, hotel_id, {text_ts('token_expires_at')} from dispatch_orders
        where dispatch_status = 'Pending_Rider' and dispatch_orders.token_expires_at <= timestamp '{AS_OF}'""",
    ),
    query(
        "ds3_cascade",
        lambda t: cascaded(t).select(
            "order_id", "assigned_rider_id", "dispatch_status", "dispatch_attempts", "event_type",
            F.array_join(F.transform("notified_rider_ids", lambda x: x.cast("string")), ",").alias("notified"),
            shown("token_expires_at"),
        ),
        f"""select order_id, coalesce(next_id, assigned_rider_id) as assigned_rider_id,
        case when next_id is null then 'Unassigned_No_Riders' else 'Pending_Rider' end as dispatch_status,
        dispatch_attempts + case when next_id is null then 0 else 1 end as dispatch_attempts,
        case when next_id is null then 'CASCADE_EXHAUSTED' else 'TIMEOUT_EXPIRED' end as event_type,
        array_to_string(told, ',') as notified,
        case when next_id is null then strftime(token_expires_at, '%Y-%m-%d %H:%M:%S') else '1998-06-30 00:05:00' end as token_expires_at
        from cascaded_rows""",
        **CASCADE_CTES,
    ),
    query(
        "ds3_declined_offers",
        lambda t: shown_cascade(declined(t)),
        CASCADE_RESULT_SQL.format(rows="declined_moved", kind="ORDER_DEACTIVATED"),
        **RANK_CTES,
        notified_orders=NOTIFIED_SQL,
        declined_rows=DECLINED_SQL,
        declined_moved=CASCADED_SQL.replace("open_rows", "declined_rows"),
    ),
    query(
        "ds4_expired_clicks",
        lambda t: shown_cascade(
            dispatch.cascade_expired(open_orders(t), dispatch.activation_outcomes(dispatched(t), activation_requests(t)), couriers(t))
        ),
        CASCADE_RESULT_SQL.format(rows="clicked_moved", kind="TIMEOUT_EXPIRED"),
        **RANK_CTES,
        notified_orders=NOTIFIED_SQL,
        request_rows=REQUESTS_SQL,
        outcome_rows=OUTCOMES_SQL,
        clicked_rows=CLICKED_SQL,
        clicked_moved=CASCADED_SQL.replace("open_rows", "clicked_rows"),
    ),
    query(
        "ds4_activation_outcomes",
        lambda t: dispatch.activation_outcomes(dispatched(t), activation_requests(t)).select("order_id", "event_id", "outcome"),
        "select order_id, event_id, outcome from outcome_rows",
        request_rows=REQUESTS_SQL,
        outcome_rows=OUTCOMES_SQL,
    ),
    query(
        "ds4_activated_orders",
        lambda t: dispatch.apply_activations(
            dispatched(t), dispatch.activation_outcomes(dispatched(t), activation_requests(t))
        ).select("order_id", "dispatch_status", shown("activated_at")),
        f"""select d.id as order_id, case when o.ts is not null then 'Active' else dispatch_status end as dispatch_status,
        {text_ts('o.ts', 'activated_at')} from dispatch_orders d
        left join (select * from outcome_rows where outcome = 'activated') o on o.order_id = d.id""",
        request_rows=REQUESTS_SQL,
        outcome_rows=OUTCOMES_SQL,
    ),
    query(
        "ds5_complete_orders",
        lambda t: completed(t).select("order_id", "dispatch_status", "actual_duration_min", "was_on_time"),
        "select id as order_id, 'Delivered' as dispatch_status, actual as actual_duration_min, was_on_time from completed_rows",
        completed_rows=COMPLETED_SQL,
    ),
    query(
        "ds5_completion_history",
        lambda t: dispatch.completion_history(completed(t)).select(
            "hotel_id", "order_reference", "predicted_time_min", "risk_status", "source_type"
        ),
        """select hotel_id, tracking_id as order_reference, predicted_eta_min as predicted_time_min,
        case was_on_time when 1 then 'Fast / Low Risk' else 'High Delay Risk' end as risk_status, 'dispatch_delivery' as source_type
        from completed_rows""",
        completed_rows=COMPLETED_SQL,
    ),
    query(
        "ds5_rider_status_changes",
        lambda t: dispatch.rider_status_changes(
            dispatch.activation_outcomes(dispatched(t), activation_requests(t)), completed(t)
        ).select("rider_id", "status", shown("ts")),
        f"""select assigned_rider_id as rider_id, 'On Delivery' as status, {text_ts('ts')} from outcome_rows where outcome = 'activated'
        union all select assigned_rider_id, 'Available', strftime(completed_at, '%Y-%m-%d %H:%M:%S') from completed_rows""",
        request_rows=REQUESTS_SQL,
        outcome_rows=OUTCOMES_SQL,
        completed_rows=COMPLETED_SQL,
    ),
    query(
        "ds6_audit_events",
        lambda t: audit_trail(t).withColumn("created_at", F.date_format("created_at", FORMAT)),
        AUDIT_SQL,
        **CASCADE_CTES,
        request_rows=REQUESTS_SQL,
        outcome_rows=OUTCOMES_SQL,
        completed_rows=COMPLETED_SQL,
    ),
    query(
        "ds7_notifications",
        lambda t: dispatch.notifications(offers(t)).withColumn("sent_at", F.date_format("sent_at", FORMAT)),
        f"""select tracking_id, assigned_rider_id as rider_id, case when r.id % 2 = 0 then 'r' || r.id || '@mail.com'
          else replace(lower(rider_name), ' ', '.') || '@example.com' end as recipient_email,
        chr(128230) || ' URGENT Delivery Mission: ' || tracking_id || ' [' || distance_km || ' km ' || chr(8226) || ' ~' || predicted_eta_min || ' min]' as subject,
        'SIMULATED' as status, {text_ts('d.created_at', 'sent_at')} from dispatch_orders d join riders r on r.id = d.assigned_rider_id""",
    ),
    query(
        "ag5_rider_ratings",
        lambda t: ratings.updated_ratings(t.riders.select("id", "rating"), rating_events(t)),
        """select id, case when n is null then rating else list_reduce(list_concat([rating], flags),
          lambda a, x: least(5.0e0, {})) end as rating
        from riders left join (select assigned_rider_id as rid, count(*) as n,
          list(cast(actual_duration_min <= predicted_eta_min + 2 as int)::double order by created_at, id) as flags
          from dispatch_orders where dispatch_status = 'Delivered' group by 1) on rid = id""".replace(
            "{}", py_round_sql("(a + case x when 1 then 0.05e0 else -0.05e0 end)", 1)
        ),
    ),
    query("mu1_profile_upsert", merged_accounts, MERGED_SQL, account_changes=ACCOUNT_CHANGES_SQL),
    query(
        "mu2_rider_upsert_delete",
        lambda t: mutations.merge_snapshot(rider_table(t), rider_changes(t), "id", "seq"),
        """select coalesce(r.id, c.id) as id, case when c.id is null then r.hotel_id else c.hotel_id end as hotel_id,
        case when c.id is null then r.rider_name else c.rider_name end as rider_name,
        case when c.id is null then r.vehicle_type else c.vehicle_type end as vehicle_type, case when c.id is null then r.rating else c.rating end as rating
        from riders r full join (select rider_id % 160 as id, event_id % 25 as hotel_id, 'Rider ' || event_id as rider_name,
          case when event_id % 2 = 0 then 'Bike' else 'Car' end as vehicle_type, cast(40 + event_id % 11 as double) as rating, action = 'STATUS' as deleted
          from dispatch_events qualify row_number() over (partition by rider_id % 160 order by event_id desc) = 1) c on c.id = r.id
        where not coalesce(c.deleted, false)""",
    ),
    query("mu3_latest_positions", positions, POSITIONS_SQL),
    query("mu3_compacted_positions", compacted_positions, POSITIONS_SQL),
    query(
        "mu4_prediction_log",
        lambda t: mutations.prediction_log(history_rows(t), "minutes", "batch"),
        "select * from history_rows",
        history_rows=HISTORY_SQL,
    ),
    query(
        "mu4_clear_history",
        lambda t: mutations.clear_history(mutations.prediction_log(history_rows(t), "minutes", "batch"), 7).select(
            "hotel_id", "order_reference"
        ),
        "select hotel_id, order_reference from history_rows where hotel_id <> 7",
        history_rows=HISTORY_SQL,
    ),
    query(
        "st4_countdown",
        lambda t: dispatch.countdown(dispatched(t), "1998-06-30 00:02:30").select("order_id", "seconds_left", "expired", "shown"),
        """select order_id, seconds_left, remaining <= 0 as expired, case when remaining <= 0 then '00:00 (EXPIRED)'
          else lpad(cast(seconds_left // 60 as varchar), greatest(2, len(cast(seconds_left // 60 as varchar)))::int, '0') || ':' || lpad(cast(seconds_left % 60 as varchar), 2, '0') end as shown
        from (select *, cast(greatest(0, floor(remaining)) as bigint) as seconds_left from (select id as order_id,
          (epoch_us(token_expires_at) - epoch_us(timestamp '1998-06-30 00:02:30')) / 1e6 as remaining
          from dispatch_orders where dispatch_status = 'Pending_Rider'))""",
    ),
]
