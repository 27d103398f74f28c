"""Recent-row listings, filters, deduplication and key set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def recent(
    df: DataFrame, order_by: list[Column], limit: int, offset: int = 0, where: Column | None = None
) -> DataFrame:
    """Newest rows of a filtered table; a bounded top-k per task, then one merge."""
    kept = df if where is None else df.where(where)
    ordered = kept.orderBy(*order_by)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def recent_per_group(df: DataFrame, by: str, newest: Column, limit: int = 50) -> DataFrame:
    """Newest rows of every group; deeper rows are dropped before the shuffle."""
    ranked = Window.partitionBy(by).orderBy(newest)
    return df.withColumn("recency", F.row_number().over(ranked)).where(F.col("recency") <= limit)


def latest_row(df: DataFrame, order_columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Row with the greatest ordering, overall or per group, as an aggregate."""
    newest = F.max_by(F.struct(*df.columns), F.struct(*order_columns)).alias("row")
    picked = df.groupBy(*by).agg(newest) if by else df.agg(newest)
    return picked.select("row.*")


def riders_with_status(riders: DataFrame, hotel_id: int | None, status: str | None) -> DataFrame:
    """Riders of a hotel by status, ignoring case; ``all`` or no status means any."""
    kept = riders if hotel_id is None else riders.where(F.col("hotel_id") == hotel_id)
    if status and status.strip().lower() != "all":
        kept = kept.where(F.lower("status") == status.strip().lower())
    return kept


def kitchen_listing(
    items: DataFrame,
    newest: list[Column],
    hotel_id: int | None = None,
    tracking_id: str | None = None,
    statuses: str | None = None,
    limit: int = 100,
) -> DataFrame:
    """Newest kitchen items, optionally of one hotel, one order or some statuses."""
    kept = items
    if hotel_id is not None:
        kept = kept.where(F.col("hotel_id") == hotel_id)
    if tracking_id:
        kept = kept.where(F.col("tracking_id") == tracking_id.strip())
    wanted = [s.strip().capitalize() for s in (statuses or "").split(",") if s.strip()]
    if wanted:
        kept = kept.where(F.col("status").isin(wanted))
    return kept.orderBy(*newest).limit(limit)


def preview(df: DataFrame, order_by: list[Column], rows: int = 10) -> DataFrame:
    """First rows as text, nulls shown as empty."""
    first = df.orderBy(*order_by).limit(rows)
    return first.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in first.columns]
    )


def keep_last(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Last row per key by sequence number."""
    return latest_row(df, [sequence], keys)


def training_extract(orders: DataFrame) -> DataFrame:
    """Completed deliveries under their training names; every one, not the newest few."""
    return orders.where(F.col("dispatch_status") == "Delivered").select(
        "id",
        "tracking_id",
        "distance_km",
        "weather",
        "traffic_level",
        "time_of_day",
        "vehicle_type",
        "prep_time_min",
        "courier_exp_yrs",
        "predicted_eta_min",
        "actual_duration_min",
        F.col("actual_duration_min").alias("actual_delivery_minutes"),
        F.col("predicted_eta_min").alias("predicted_eta_minutes"),
        F.col("prep_time_min").alias("preparation_time_min"),
        F.col("courier_exp_yrs").alias("courier_experience_yrs"),
        "dispatch_status",
        "created_at",
    )


def stack_rows(*tables: DataFrame) -> DataFrame:
    """Concatenate by column name, filling absent columns with nulls."""
    stacked = tables[0]
    for table in tables[1:]:
        stacked = stacked.unionByName(table, allowMissingColumns=True)
    return stacked


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every distinct key with the side it occurs on: left_only, right_only or both."""
    sides = left.select(F.col(key), F.lit(1).alias("side")).unionByName(
        right.select(F.col(key), F.lit(2).alias("side"))
    )
    low, high = F.min("side"), F.max("side")
    where = F.when(low != high, "both").when(low == 1, "left_only").otherwise("right_only")
    return sides.groupBy(key).agg(where.alias("found"))
