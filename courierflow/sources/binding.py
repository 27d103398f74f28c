"""The test tables seen as delivery-operations tables.

The statements below run unchanged in Spark (over DataFrames) and as common
table expressions in the SQL oracle, so both sides start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)

VIEWS = {
    "hotels": """
select cast(n_nationkey as bigint) as hotel_id, n_name as hotel_name,
  round(cast(-60 + n_nationkey * 5 as double) + 0.7306, 6) as latitude,
  round(cast(-170 + n_nationkey * 13 as double) + 0.0134, 6) as longitude,
  cast(10 + n_nationkey % 11 as double) as default_prep_time_min,
  case n_nationkey % 3 when 0 then 'Bike' when 1 then 'Scooter' else 'Car' end as default_vehicle_type
from nation
""",
    "riders": """
select s_suppkey as id, h.hotel_id, s_name as rider_name,
  case s_suppkey % 3 when 0 then 'Bike' when 1 then 'Scooter' else 'Car' end as vehicle_type,
  cast(s_suppkey % 10 as double) as courier_exp_yrs,
  cast(40 + s_suppkey % 11 as double) / 10 as rating,
  case s_suppkey * 7 % 4 when 0 then 'Available' when 1 then 'available' when 2 then 'On Delivery' else 'Offline' end as status,
  case when s_suppkey % 29 = 3 then 0.0e0 else round(h.latitude + cast(s_suppkey * 37 % 201 - 100 as double) / 10000, 6) end as current_lat,
  case when s_suppkey % 29 = 3 then 0.0e0 else round(h.longitude + cast(s_suppkey * 53 % 201 - 100 as double) / 10000, 6) end as current_lng,
  s_suppkey * 17 % 30 as total_deliveries,
  case when s_suppkey * 17 % 30 > s_suppkey % 5 then s_suppkey * 17 % 30 - s_suppkey % 5 else 0 end as on_time_deliveries
from supplier join hotels h on s_nationkey = h.hotel_id
""",
    "deliveries_base": """
select o_orderkey as order_id, cast(c_nationkey as bigint) as hotel_id, o_orderkey % (select count(*) from supplier) as rider_id,
  round(0.59 + cast(o_orderkey * 7919 % 1941 as double) / 100, 2) as distance_km,
  case when o_orderkey % 33 = 5 then null else case o_orderkey * 31 % 97 % 10 when 0 then 'Snowy' when 1 then 'Foggy' when 2 then 'Windy' when 3 then 'Rainy' when 4 then 'Rainy' else 'Clear' end end as weather,
  case when o_orderkey % 33 = 11 then null when o_orderpriority = '1-URGENT' then 'High' when o_orderpriority in ('2-HIGH', '3-MEDIUM') then 'Medium' else 'Low' end as traffic_level,
  case when o_orderkey % 33 = 17 then null when o_orderkey * 13 % 24 between 5 and 11 then 'Morning' when o_orderkey * 13 % 24 between 12 and 16 then 'Afternoon' when o_orderkey * 13 % 24 between 17 and 21 then 'Evening' else 'Night' end as time_of_day,
  case c_mktsegment when 'BUILDING' then 'Scooter' when 'AUTOMOBILE' then 'Car' when 'MACHINERY' then 'Scooter' else 'Bike' end as vehicle_type,
  cast(5 + o_custkey % 25 as double) as preparation_time_min,
  case when o_orderkey % 33 = 23 then null else cast(o_orderkey % (select count(*) from supplier) % 10 as double) end as courier_experience_yrs,
  cast(o_orderkey * 104729 % 2001 as double) / 100 - 10 as noise
from orders join customer on o_custkey = c_custkey
""",
    "deliveries": """
select order_id, hotel_id, rider_id, distance_km, weather, traffic_level, time_of_day, vehicle_type, preparation_time_min, courier_experience_yrs,
  cast(greatest(8.0e0, round(11 + 2.95e0 * distance_km + 0.9e0 * preparation_time_min
    + case weather when 'Snowy' then 10.0e0 when 'Rainy' then 5.0e0 when 'Foggy' then 6.0e0 else 0.0e0 end
    + case traffic_level when 'High' then 11.0e0 when 'Medium' then 5.0e0 else 0.0e0 end
    - 0.5e0 * coalesce(courier_experience_yrs, 4.0e0) + noise, 0)) as bigint) as delivery_time_min
from deliveries_base
""",
    "dispatch_orders": """
select d.order_id as id, d.hotel_id, concat('TRK-', lpad(cast(d.order_id as varchar(12)), 8, '0')) as tracking_id,
  d.rider_id as assigned_rider_id, d.distance_km, d.weather, d.traffic_level, d.time_of_day, d.vehicle_type,
  d.preparation_time_min as prep_time_min, d.courier_experience_yrs as courier_exp_yrs,
  round(12 + 3.0e0 * d.distance_km + d.preparation_time_min, 2) as predicted_eta_min,
  case o_orderstatus when 'F' then 'Delivered' when 'O' then 'Active' else 'Pending_Rider' end as dispatch_status,
  case when o_orderstatus = 'F' then cast(d.delivery_time_min as double) end as actual_duration_min,
  1 + d.order_id % 3 as dispatch_attempts,
  cast(o_orderdate as timestamp) as created_at, cast(o_orderdate as timestamp) + interval 5 minute as token_expires_at
from deliveries d join orders o on d.order_id = o.o_orderkey
""",
    "kitchen_queue": """
select l_orderkey as order_id, l_linenumber as line_no, l_partkey as item_id, l_suppkey as station_id, p_name as item_name,
  cast(l_quantity as bigint) as quantity,
  case when l_linenumber = 1 then 0.0e0 else cast(floor(p_retailprice) as double) / 100 end as unit_price,
  case l_returnflag when 'R' then ' Extra spicy, no onions ' when 'A' then '' end as special_instructions,
  case when l_linestatus = 'F' and l_returnflag = 'N' then 'completed' when l_linestatus = 'F' then 'READY' when l_returnflag = 'N' then 'burnt' else 'pending' end as raw_status
from lineitem join part on l_partkey = p_partkey
""",
    "weather_obs": """
select event_id as obs_id, user_id % 25 as hotel_id, cast(ts as timestamp) as obs_ts, event_id * 7 % 100 as weathercode,
  cast(floor(value) as double) / 4 as windspeed
from events
""",
    "dispatch_events": """
select event_id, cast(ts as timestamp) as ts, event_id - event_id % 5 as order_no, user_id as rider_id,
  case when event_id % 5 = 0 then 'DISPATCH_TRIGGERED' when event_type = 'click' then 'ACTIVATE' when event_type = 'error' then 'DEACTIVATE' when event_type = 'purchase' then 'COMPLETE' when event_type = 'view' then 'LOCATION' else 'STATUS' end as action,
  value
from events
""",
}

# Views whose join of a growing table with itself Spark may not broadcast: it judges a table by its
# compressed files, and tasks would hold a hash table of all keys that grows with the table.
MERGED = {"dispatch_orders": "orders"}


def _names_in(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_]+", sql))
    return [name for name in (*BASE_TABLES, *VIEWS) if name in words]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """Lazily built DataFrames for one data folder: ``Tables(spark, dir).deliveries``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self._dir = sf_dir
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in BASE_TABLES and name not in VIEWS):
            raise AttributeError(name)
        if name not in self._built:
            if name in BASE_TABLES:
                self._built[name] = read_table(self.spark, self._dir, name)
            else:
                self._built[name] = self.sql(VIEWS[name], merged=MERGED.get(name))
        return self._built[name]

    def sql(self, statement: str, merged: str | None = None) -> DataFrame:
        """Run SQL whose table names are this binding's tables; ``merged`` is joined by sort merge."""
        names = _names_in(statement)
        pattern = r"\b(from|join)\s+(" + "|".join(names) + r")\b"
        text = re.sub(pattern, r"\1 {\2}", statement)
        bound = {n: getattr(self, n) for n in names}
        if merged:
            bound[merged] = bound[merged].hint("merge")
        return self.spark.sql(text, **bound)


def with_views(select: str, **extra: str) -> str:
    """Prefix ``select`` with the views (and named ``extra`` queries) it needs."""
    available = {**VIEWS, **extra}
    ordered: list[str] = []

    def visit(sql: str, path: tuple[str, ...]) -> None:
        for word in sorted(set(re.findall(r"[a-z_0-9]+", sql))):
            if word in available and word not in ordered and word not in path:
                visit(available[word], (*path, word))
                ordered.append(word)

    visit(select, ())
    parts = [f"{name} as ({available[name].strip()})" for name in ordered]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + select.strip()
