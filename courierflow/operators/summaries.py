"""Fleet, history and batch figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierflow import domain as D
from courierflow.functions.rounding import py_round


def fleet_stats(riders: DataFrame, hotels: DataFrame | None = None) -> DataFrame:
    """Riders per hotel by status and their average experience, in one pass.

    With ``hotels`` given, hotels without riders appear with zeros.
    """

    def with_status(status: str):
        return F.count_if(F.lower("status") == status)

    stats = riders.groupBy("hotel_id").agg(
        F.count("*").alias("total_riders"),
        with_status("available").alias("available_riders"),
        with_status("on delivery").alias("on_delivery_riders"),
        with_status("offline").alias("offline_riders"),
        F.coalesce(py_round(F.avg("courier_exp_yrs"), 1), F.lit(0.0)).alias("avg_experience_yrs"),
    )
    if hotels is None:
        return stats
    return hotels.select("hotel_id").join(stats, "hotel_id", "left").na.fill(0)


def batch_kpis(scored: DataFrame, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Order count, prediction range and risk counts of a scored table."""
    minutes = F.col(predicted)
    return scored.groupBy(*(by or [])).agg(
        F.count("*").alias("total_orders"),
        py_round(F.avg(minutes), 2).alias("avg_delivery_time_min"),
        py_round(F.min(minutes), 2).alias("min_delivery_time_min"),
        py_round(F.max(minutes), 2).alias("max_delivery_time_min"),
        F.count_if(F.col("risk_status") == D.RISK_HIGH).alias("high_risk_count"),
        F.count_if(F.col("risk_status") == D.RISK_FAST).alias("fast_delivery_count"),
    )


def history_counts(history: DataFrame) -> DataFrame:
    return history.groupBy("hotel_id").agg(F.count("*").alias("records"))


def rider_performance(riders: DataFrame, completed: DataFrame) -> DataFrame:
    """Rider counters after adding completed deliveries, and the on-time score.

    ``completed`` has assigned_rider_id and was_on_time; it is summed per rider
    before it meets the rider table.
    """
    added = completed.groupBy(F.col("assigned_rider_id").alias("id")).agg(
        F.count("*").alias("_done"), F.sum(F.col("was_on_time").cast("bigint")).alias("_on_time")
    )
    total = F.coalesce("total_deliveries", F.lit(0)) + F.coalesce("_done", F.lit(0))
    on_time = F.coalesce("on_time_deliveries", F.lit(0)) + F.coalesce("_on_time", F.lit(0))
    return (
        riders.join(added, "id", "left")
        .withColumns({"total_deliveries": total, "on_time_deliveries": on_time})
        .withColumn(
            "performance_score",
            F.when(
                F.col("total_deliveries") > 0,
                py_round(F.try_divide("on_time_deliveries", "total_deliveries") * 100.0, 1),
            ).otherwise(F.lit(100.0)),
        )
        .drop("_done", "_on_time")
    )
