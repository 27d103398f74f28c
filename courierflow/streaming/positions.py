"""Rider positions and statuses from an event stream, kept in a table of merged segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from courierflow.sources import segments

STAMPS = ["moved_at", "addressed_at", "status_at"]


def _moment():
    return F.struct("ts", "event_id")


def reduce_events(events: DataFrame) -> DataFrame:
    """Last position, address and status per rider, each with when it was said."""

    def last(value, given: str):
        return F.max_by(value, F.when(F.col(given).isNotNull(), _moment()))

    def said(given: str):
        return F.max(F.when(F.col(given).isNotNull(), _moment()))

    return events.groupBy("rider_id").agg(
        last(F.struct("lat", "lng"), "lat").alias("position"),
        said("lat").alias("moved_at"),
        last(F.col("address"), "address").alias("address"),
        said("address").alias("addressed_at"),
        last(F.trim("status"), "status").alias("status"),
        said("status").alias("status_at"),
        F.max("ts").alias("last_active_at"),
    )


def merge_reduced(known: DataFrame, news: DataFrame) -> DataFrame:
    """Two reduced tables into one, the later word winning, in whatever order they came."""
    both = known.unionByName(news)
    return both.groupBy("rider_id").agg(
        F.max_by("position", "moved_at").alias("position"),
        F.max("moved_at").alias("moved_at"),
        F.max_by("address", "addressed_at").alias("address"),
        F.max("addressed_at").alias("addressed_at"),
        F.max_by("status", "status_at").alias("status"),
        F.max("status_at").alias("status_at"),
        F.max("last_active_at").alias("last_active_at"),
    )


def start_positions(events: DataFrame, path: str, checkpoint: str, fan: int = segments.FAN) -> StreamingQuery:
    """Keep a table of riders up to date; a micro-batch writes the riders it tells of.

    The table consists of segments, merged as their number grows, so no batch rewrites all
    riders but one in many. A repeated batch writes the same segment again.
    """

    def write(batch: DataFrame, number: int) -> None:
        segments.append(reduce_events(batch), path, number, merge_reduced, fan)

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_snapshot(spark: SparkSession, path: str, last_batch: int, fan: int = segments.FAN) -> DataFrame | None:
    return segments.read(spark, path, last_batch + 1, merge_reduced, fan)


def apply_snapshot(riders: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Riders with the snapshot's position, address and status where given."""
    known = snapshot.select(
        F.col("rider_id").alias("id"),
        "position",
        F.col("address").alias("_address"),
        F.col("status").alias("_status"),
        "last_active_at",
    )
    return (
        riders.join(known, "id", "left")
        .withColumns(
            {
                "current_lat": F.coalesce("position.lat", "current_lat"),
                "current_lng": F.coalesce("position.lng", "current_lng"),
                "current_address": F.coalesce("_address", "current_address"),
                "status": F.coalesce("_status", "status"),
            }
        )
        .drop("position", "_address", "_status")
    )
