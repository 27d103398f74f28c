"""Kitchen display feed: new orders without any price, and status changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from courierflow.operators.kitchen import charged_quantity, clean_status, normalize_items


def order_feed(payloads: DataFrame) -> DataFrame:
    """Events of new orders, from payload rows with an array of items.

    Only the named item fields pass, so prices cannot; a projection, no state.
    """
    items = F.col("items")
    shown = F.transform(
        items,
        lambda it: F.struct(
            it["item_name"].alias("item_name"),
            F.coalesce(it["quantity"], F.lit(1)).cast("bigint").alias("quantity"),
            it["special_instructions"].alias("special_instructions"),
            F.coalesce(it["status"], F.lit("Pending")).alias("status"),
        ),
    )
    total = F.aggregate(shown, F.lit(0).cast("bigint"), lambda n, it: n + it["quantity"])
    return payloads.select(
        F.lit("new_kitchen_order").alias("event"),
        "tracking_id",
        F.coalesce("order_id", "tracking_id").alias("order_id"),
        F.coalesce("hotel_id", F.lit(1).cast("bigint")).alias("hotel_id"),
        "timestamp",
        shown.alias("items"),
        F.coalesce(total, F.lit(0).cast("bigint")).alias("total_items"),
    )


def item_feed(items: DataFrame, keys: list[str]) -> DataFrame:
    """One event per queued item, for feeds whose orders arrive item by item."""
    return normalize_items(items).select(
        F.lit("new_kitchen_item").alias("event"),
        *keys,
        "item_name",
        charged_quantity().alias("quantity"),
        "special_instructions",
        "status",
    )


def status_feed(events: DataFrame) -> DataFrame:
    """Events of valid status changes."""
    return events.withColumn("status", clean_status(F.col("status"))).where("status is not null").select(
        F.lit("item_status_updated").alias("event"),
        "event_id",
        "order_id",
        "line_no",
        "status",
        F.col("ts").alias("updated_at"),
    )


def start_feed(feed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a feed to a table, reading all that is available."""
    return (
        feed.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
