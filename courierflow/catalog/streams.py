"""ST1-ST3: streaming jobs, run over the event and item files until all is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierflow.catalog.base import query
from courierflow.catalog.dispatch import (
    FORMAT,
    NEW_DISPATCH_SQL,
    POSITIONS_SQL,
    addressed_riders,
    dispatch_requests,
    rider_events,
    shown_dispatches,
)
from courierflow.catalog.kitchen import ITEM_KEYS, ITEMS_SQL, STATUS_EVENTS_SQL, status_events
from courierflow.catalog.lookups import RANK_CTES, WEATHER_SQL, couriers, observed_orders
from courierflow.operators import assignment, matching
from courierflow.plans.dispatching import create_dispatches
from courierflow.session import work_path
from courierflow.sources import history
from courierflow.sources.binding import VIEWS, Tables
from courierflow.streaming import dispatching, kitchen_feed, lifecycle, positions

DELAY = "10 minutes"


class StreamTables(Tables):
    """The binding with some base tables read as file streams."""

    def __init__(self, t: Tables, streamed: set[str]):
        super().__init__(t.spark, t._dir)
        for name in streamed:
            static = getattr(t, name)
            # The file source takes folders or patterns; the pattern names the one file.
            self._built[name] = (
                t.spark.readStream.schema(static.schema).parquet(f"{t._dir}/{name}.parq*")
            )


def order_hotels(events: DataFrame):
    hotel = (F.floor(F.col("order_no") / 5) % 25).cast("bigint")
    return events.withColumn("hotel_id", hotel)


def lifecycle_events(events: DataFrame, t: Tables) -> DataFrame:
    """Dispatch events with how many couriers their order's hotel has."""
    per_hotel = couriers(t).groupBy("hotel_id").agg(F.count("*").cast("int").alias("candidates"))
    return (
        order_hotels(events)
        .join(per_hotel, "hotel_id", "left")
        .na.fill({"candidates": 0})
        .withColumn("order_id", F.col("order_no"))
    )


def run_lifecycle(t: Tables) -> DataFrame:
    """Stream the event log; runs are expanded and resolved to couriers afterwards."""
    path = work_path(t.spark, "lifecycle")
    stream = StreamTables(t, {"events"}).dispatch_events
    done = lifecycle.start_lifecycle(
        lifecycle_events(stream, t), path, work_path(t.spark, "lifecycle-checkpoint"), DELAY
    )
    done.awaitTermination()
    return lifecycle.read_runs(t.spark, path)


LATENESS = "case when event_id % 97 = 13 then 9 else 0 end"  # days from an event to its arrival


def late_rows(t: Tables) -> DataFrame:
    """The log arrives in parts of eight days, some events nine days after their time; the late side of the stream."""
    path, arrivals, checkpoint = (work_path(t.spark, n) for n in ("lifecycle", "arrivals", "lifecycle-checkpoint"))
    log = t.dispatch_events.withColumn("part", F.expr(f"(datediff(ts, date'2024-01-01') + {LATENESS}) div 8"))
    for part in [r[0] for r in log.select("part").distinct().orderBy("part").collect()]:
        log.where(F.col("part") == part).drop("part").write.mode("append").parquet(arrivals)
        stream = lifecycle_events(t.spark.readStream.schema(t.dispatch_events.schema).parquet(arrivals), t)
        lifecycle.start_lifecycle(stream, path, checkpoint, DELAY).awaitTermination()
    late = lifecycle.read_late(t.spark, path)
    return late.select("order_id", "event_id", "action", F.date_format("ts", FORMAT).alias("at"))


LATE_SQL = f"""
select order_no as order_id, event_id, action, strftime(ts, '%Y-%m-%d %H:%M:%S') as at
from (select *, max(latest) over (order by part groups between unbounded preceding and 1 preceding) as seen
  from (select *, max(epoch_ms(ts)) over (partition by part) as latest
    from (select *, (date_diff('day', date '2024-01-01', cast(ts as date)) + {LATENESS}) // 8 as part from dispatch_events)))
where epoch_us(ts) <= (seen - 600000) * 1000
"""


def watermark(t: Tables) -> str:
    """Where the watermark stands once the log is read: its last time less the delay."""
    last = t.dispatch_events.agg(
        (F.max("ts") - F.make_dt_interval(mins=F.lit(10))).cast("string")
    ).first()[0]
    # Watermarks have whole milliseconds.
    return last[:23]


def resolved(t: Tables, life: DataFrame) -> DataFrame:
    hotels = order_hotels(t.dispatch_events.select("order_no").distinct()).select(
        F.col("order_no").alias("order_id"), "hotel_id"
    )
    ranked = assignment.rank_couriers(couriers(t))
    return lifecycle.with_couriers(life, ranked, hotels).select(
        "order_id", "event_type", "attempt", "rider_id", F.date_format("at", FORMAT).alias("at"), "duration_min"
    )


def streamed_positions(t: Tables) -> DataFrame:
    path = work_path(t.spark, "positions")
    stream = rider_events(StreamTables(t, {"events"}))
    done = positions.start_positions(stream, path, work_path(t.spark, "positions-checkpoint"))
    done.awaitTermination()
    last = done.lastProgress.batchId
    while (snapshot := positions.latest_snapshot(t.spark, path, last)) is None and last > 0:
        last -= 1
    moved = positions.apply_snapshot(addressed_riders(t), snapshot)
    return moved.withColumn("last_active_at", F.date_format("last_active_at", FORMAT))


def streamed_dispatches(t: Tables) -> DataFrame:
    path, observed = work_path(t.spark, "dispatches"), work_path(t.spark, "weather-history")
    history.add_observations(t.weather_obs, observed, 0, "hotel_id", "obs_ts", "obs_id")

    def create(requests: DataFrame) -> DataFrame:
        weather = history.in_days(requests, observed, 0, t.weather_obs, "hotel_id", "created_at", "obs_ts")
        return create_dispatches(requests, t.hotels, couriers(t), weather)

    dispatching.start_dispatching(
        dispatch_requests(StreamTables(t, {"events"})),
        create,
        path,
        work_path(t.spark, "dispatches-checkpoint"),
    ).awaitTermination()
    return shown_dispatches(t.spark.read.parquet(path))


def run_feed(t: Tables, feed: DataFrame) -> DataFrame:
    path = work_path(t.spark, "kitchen-feed")
    kitchen_feed.start_feed(feed, path, work_path(t.spark, "kitchen-checkpoint")).awaitTermination()
    return t.spark.read.schema(feed.schema).parquet(path)


def streamed_items(t: Tables) -> DataFrame:
    items = StreamTables(t, {"lineitem"}).sql(VIEWS["kitchen_queue"])
    return run_feed(t, kitchen_feed.item_feed(items, ["order_id", *ITEM_KEYS]))


def streamed_statuses(t: Tables) -> DataFrame:
    feed = kitchen_feed.status_feed(status_events(StreamTables(t, {"events"})))
    return run_feed(t, feed).withColumn("updated_at", F.date_format("updated_at", FORMAT))


def weather_from_history(t: Tables) -> DataFrame:
    """Weather in force at every order of the log, from a history that grew by two batches, the older days last."""
    path = work_path(t.spark, "weather-history")
    late = F.col("obs_id") % 3 == 0
    for version, part in enumerate((t.weather_obs.where(~late), t.weather_obs.where(late))):
        history.add_observations(part, path, version, "hotel_id", "obs_ts", "obs_id")
    orders = observed_orders(t)
    weather = history.in_days(orders, path, 1, t.weather_obs, "hotel_id", "ts", "obs_ts")
    return matching.with_weather_in_force(orders, weather, "ts").select("event_id", "hotel_id", "obs_id", "weather_now")


QUERIES = [
    query("jn9_weather_from_history", weather_from_history, WEATHER_SQL),
    query("ds1_dispatch_stream", streamed_dispatches, NEW_DISPATCH_SQL, **RANK_CTES),
    query("st1_late_rows", late_rows, LATE_SQL),
    query("st1_lifecycle_stream", lambda t: resolved(t, run_lifecycle(t))),
    query(
        "st1_lifecycle_replay",
        lambda t: resolved(t, lifecycle.replay_runs(lifecycle_events(t.dispatch_events, t), watermark(t))),
    ),
    query("st2_position_stream", streamed_positions, POSITIONS_SQL),
    query(
        "st3_kitchen_item_stream",
        streamed_items,
        """select 'new_kitchen_item' as event, order_id, line_no, item_id, station_id, item_name, quantity, special_instructions, status
        from item_rows""",
        item_rows=ITEMS_SQL,
    ),
    query(
        "st3_status_stream",
        streamed_statuses,
        """select 'item_status_updated' as event, event_id, order_id, cast(line_no as int) as line_no,
        upper(left(status, 1)) || lower(substr(status, 2)) as status, strftime(ts, '%Y-%m-%d %H:%M:%S') as updated_at
        from status_events where status <> 'lost'""",
        status_events=STATUS_EVENTS_SQL,
    ),
]
