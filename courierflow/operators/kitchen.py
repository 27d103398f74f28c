"""Kitchen queue: item normalization, status changes, bills and price-free totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierflow import domain as D
from courierflow.functions.rounding import py_round
from courierflow.functions.scalars import blank_to_null, capitalize, or_default

# Paper widths in characters and the price of an unpriced item.
PAPER_COLUMNS = {"58mm": 32, "80mm": 42}
FALLBACK_PRICE = {"58mm": 12.00, "80mm": 14.50}

# What stands in for missing names, fees and empty orders.
DEFAULT_ITEM = "Express Chef Special"
DEFAULT_FEE = 3.50
DEFAULT_TAX_RATE = 0.08
EMPTY_ORDER_PRICE = 18.50


def clean_status(raw: Column) -> Column:
    """Capitalized status if it is a known one, else null."""
    status = F.trim(capitalize(raw))
    return F.when(status.isin(D.KITCHEN_STATUSES), status)


def normalize_items(items: DataFrame) -> DataFrame:
    """Queue items with defaults: name, quantity of at least 1, status, note and price.

    ``name``, ``qty`` and ``price`` are accepted as synonyms where present.
    """
    present = {c.lower() for c in items.columns}

    def given(*names: str, empty) -> list[Column]:
        return [F.nullif(F.col(n), F.lit(empty)) for n in names if n in present]

    name = F.coalesce(*given("item_name", "name", empty=""), F.lit(DEFAULT_ITEM))
    quantity = F.coalesce(*given("quantity", "qty", empty=0), F.lit(1)).cast("bigint")
    price = F.coalesce(*given("unit_price", "price", empty=0.0), F.lit(0.0)).cast("double")
    status_name = "raw_status" if "raw_status" in present else "status"
    return items.withColumns(
        {
            "item_name": F.trim(name),
            "quantity": F.greatest(F.lit(1), quantity),
            "special_instructions": blank_to_null(F.col("special_instructions")),
            "status": F.coalesce(clean_status(F.col(status_name)), F.lit("Pending")),
            "unit_price": price,
        }
    )


def apply_status_events(
    items: DataFrame,
    item_events: DataFrame,
    order_events: DataFrame,
    item_keys: list[str],
    order_key: str,
) -> DataFrame:
    """Current status of every item after single-item and whole-order changes.

    Events carry their key, ts, event_id and status; unknown statuses are
    rejected. Each stream is reduced to its last event per key before the join,
    so an order with many events meets its items once.
    """

    def last_event(events: DataFrame, keys: list[str], name: str) -> DataFrame:
        known = events.withColumn("status", clean_status(F.col("status"))).where("status is not null")
        last = F.max(F.struct("ts", "event_id", "status"))
        return known.groupBy(*keys).agg(last.alias(name))

    latest = F.greatest("_item_event", "_order_event")
    return (
        items.join(last_event(item_events, item_keys, "_item_event"), item_keys, "left")
        .join(last_event(order_events, [order_key], "_order_event"), order_key, "left")
        .withColumn("_event", latest)
        .withColumn("status", F.coalesce(F.col("_event.status"), F.col("status")))
        .withColumn("updated_at", F.col("_event.ts"))
        .drop("_event", "_item_event", "_order_event")
    )


def reject_status_events(events: DataFrame) -> DataFrame:
    """Status events naming an unknown status."""
    return events.where(clean_status(F.col("status")).isNull())


def charged_price(paper: str) -> Column:
    return or_default(F.col("unit_price"), FALLBACK_PRICE[paper])


def charged_quantity() -> Column:
    return F.greatest(F.lit(1), F.coalesce(F.nullif(F.col("quantity"), F.lit(0)), F.lit(1)))


def order_bills(orders: DataFrame, items: DataFrame, paper: str = "80mm") -> DataFrame:
    """Orders with item count, subtotal, fee, tax and total; an empty order has one combo.

    ``orders`` has order_id, delivery_fee and tax_rate; zero or missing fee and
    rate take the defaults.
    """
    sums = items.groupBy("order_id").agg(
        F.count("*").alias("items"),
        F.sum(charged_quantity() * charged_price(paper)).alias("_subtotal"),
    )
    subtotal = F.coalesce("_subtotal", F.lit(EMPTY_ORDER_PRICE))
    return (
        orders.join(sums, "order_id", "left")
        .withColumns(
            {
                "items": F.coalesce("items", F.lit(0)),
                "subtotal": F.round(subtotal, 2),
                "delivery_fee": or_default(F.col("delivery_fee"), DEFAULT_FEE),
                "tax": py_round(
                    F.round(subtotal, 2) * or_default(F.col("tax_rate"), DEFAULT_TAX_RATE), 2
                ),
            }
        )
        .withColumn("total", F.round(F.col("subtotal") + F.col("delivery_fee") + F.col("tax"), 2))
        .drop("_subtotal")
    )


def kitchen_totals(items: DataFrame) -> DataFrame:
    """Items and total quantity per order."""
    return items.groupBy("order_id").agg(
        F.count("*").alias("items"), F.sum(charged_quantity()).alias("total_qty")
    )


def kitchen_items(items: DataFrame, keys: list[str]) -> DataFrame:
    """Items as the kitchen sees them: no price column of any kind."""
    return items.select(*keys, "item_name", "quantity", "special_instructions", "status")
