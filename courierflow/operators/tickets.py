"""Printed delivery and kitchen tickets, as ordered lines.

A ticket is a set of rows: ``block`` is 0 for the head, 1 for items and 2 for
the foot; within a block lines follow the item keys and then ``line``. Lines of
different items are independent rows, so an order of any size is rendered by
many tasks and nothing is collected per order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierflow.functions.scalars import display_timestamp
from courierflow.operators import kitchen

HEAD, ITEMS, FOOT = 0, 1, 2
FEED = "\n\n"

# Texts that stand in for missing details.
RECEIPT_HOTEL = "DELIVERY PLATFORM"
KITCHEN_HOTEL = "EXPRESS KITCHEN"
CLIENT_NAME = "Valued Customer"
CLIENT_PHONE = "N/A"
CLIENT_ADDRESS = "Customer Address"
RECEIPT_COMBO = "Express Kitchen Gourmet Combo"
KITCHEN_COMBO = "Express Kitchen Chef Combo"
KITCHEN_COMBO_NOTE = "Cook standard"


def left_aligned(text: Column, width: int) -> Column:
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, " "))


def right_aligned(text: Column, width: int) -> Column:
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, " "))


def centered(text: Column, width: int) -> Column:
    """Text indented to the middle; of an odd gap the larger half is left on the right."""
    gap = F.greatest(F.lit(0), F.lit(width) - F.length(text))
    before = F.repeat(F.lit(" "), F.floor(gap / 2).cast("int"))
    return F.concat(before, text)


def money(amount: Column) -> Column:
    return F.format_string("$%.2f", amount)


def wrapped(text: Column, width: int, indent: str) -> Column:
    """Words laid out greedily in indented lines; an overlong word has its own line.

    A line is the longest stretch of text that fits and ends before a blank, or
    a word too long to fit. Missing or blank text gives no lines.
    """
    room = width - len(indent)
    spaced = F.trim(F.regexp_replace(text, "\\s+", " "))
    line = f"(\\S{{{room},}}|\\S.{{0,{room - 1}}})(?= |$)"
    lines = F.regexp_extract_all(spaced, F.lit(line), F.lit(1))
    return F.coalesce(
        F.transform(lines, lambda words: F.concat(F.lit(indent), words)),
        F.array().cast("array<string>"),
    )


def _printed(lines: DataFrame, width: int) -> DataFrame:
    """Lines filled up to the paper width; spacing lines stay as they are."""
    spacing = F.col("text").isin("", FEED)
    return lines.withColumn(
        "text", F.when(spacing, F.col("text")).otherwise(left_aligned(F.col("text"), width))
    )


def _ticket(
    orders: DataFrame,
    items: DataFrame,
    item_keys: list[str],
    blocks: dict[int, Column],
    item_lines: Column,
    width: int,
) -> DataFrame:
    """Rows of the order blocks (the combo only for an empty order) and rows of every item.

    ``orders`` already carries the order's sums, so the foot needs no second pass.
    """
    made = [
        F.struct(
            F.lit(block).alias("block"),
            F.when((F.col("items") == 0) | F.lit(block != ITEMS), lines).alias("lines"),
        )
        for block, lines in blocks.items()
    ]
    no_keys = [F.lit(None).cast(f.dataType).alias(f.name) for f in items.select(*item_keys).schema]
    order_rows = orders.select("order_id", F.inline(F.array(*made))).select(
        "order_id", *no_keys, "block", F.posexplode("lines").alias("line", "text")
    )
    item_rows = items.select(
        "order_id", *item_keys, F.lit(ITEMS).alias("block"), F.posexplode(item_lines).alias("line", "text")
    )
    return _printed(order_rows.unionByName(item_rows), width)


def delivery_ticket(
    orders: DataFrame, items: DataFrame, item_keys: list[str], paper: str = "80mm"
) -> DataFrame:
    """Lines of the customer receipt with prices and bill.

    ``orders`` has order_id, tracking_id, hotel_name, client_name, client_phone,
    client_address, created_at (ISO text), delivery_fee and tax_rate.
    """
    width = kitchen.PAPER_COLUMNS[paper]
    compact = width <= 36
    billed = kitchen.order_bills(orders, items, paper)
    heavy, light = F.lit("=" * width), F.lit("-" * width)

    def text(c: str, default: str) -> Column:
        return F.trim(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default)))

    def label(prefix: str, value: Column) -> Column:
        return F.concat(F.lit(prefix), value)

    def said(value: str) -> Column:
        return F.lit(value)

    def middle(value: str) -> Column:
        return centered(F.lit(value), width)

    hotel = F.upper(F.coalesce(F.nullif(F.col("hotel_name"), F.lit("")), F.lit(RECEIPT_HOTEL)))
    columns = "ITEM             QTY       TOTAL" if compact else "ITEM DESCRIPTION        QTY   PRICE    TOTAL"
    head = F.concat(
        F.array(
            heavy,
            centered(hotel, width),
            middle("DELIVERY RECEIPT & DISPATCH TICKET"),
            heavy,
            label("TRACKING ID: ", F.trim("tracking_id")),
            label("ORDER ID:    ", F.trim(F.col("order_id").cast("string"))),
            label("DATE/TIME:   ", display_timestamp(F.col("created_at"))),
            light,
            said("CUSTOMER DISPATCH DETAILS:"),
            label("Name:    ", text("client_name", CLIENT_NAME)),
            label("Phone:   ", text("client_phone", CLIENT_PHONE)),
            said("Address:"),
        ),
        wrapped(text("client_address", CLIENT_ADDRESS), width, "  "),
        F.array(light, said(columns), light),
    )

    def item_line(name: Column, quantity: Column, price: Column) -> Column:
        count = right_aligned(quantity.cast("string"), 3)
        total = money(quantity * price)
        if compact:
            cells = [F.rpad(name, 16, " "), count, right_aligned(total, 11)]
        else:
            cells = [
                F.rpad(name, 22, " "),
                count,
                right_aligned(money(price), 8),
                right_aligned(total, 8),
            ]
        return F.concat_ws(" ", *cells)

    note = F.nullif(F.col("special_instructions"), F.lit(""))
    note_text = F.concat(F.lit("* " if compact else "* Note: "), note)
    item_lines = F.concat(
        F.array(
            item_line(
                F.coalesce(F.nullif(F.col("item_name"), F.lit("")), F.lit("Item")),
                kitchen.charged_quantity(),
                kitchen.charged_price(paper),
            )
        ),
        wrapped(note_text, width, "  "),
    )
    combo = F.array(
        item_line(F.lit(RECEIPT_COMBO), F.lit(1), F.lit(kitchen.EMPTY_ORDER_PRICE))
    )

    def bill_line(name: str, amount: Column) -> Column:
        value = money(amount)
        gap = F.greatest(F.lit(1), F.lit(width - len(name)) - F.length(value))
        return F.concat(F.lit(name), F.repeat(F.lit(" "), gap), value)

    foot = F.array(
        light,
        bill_line("Subtotal:", F.col("subtotal")),
        bill_line("Delivery Fee:", F.col("delivery_fee")),
        bill_line("Sales Tax:", F.col("tax")),
        light,
        bill_line("TOTAL BILL:", F.col("total")),
        heavy,
        middle("Thank you for your order!"),
        middle("Fast & Fresh Delivery Guaranteed"),
        heavy,
        middle("[CUT PAPER HERE]"),
        F.lit(FEED),
    )
    return _ticket(
        billed, items, item_keys, {HEAD: head, ITEMS: combo, FOOT: foot}, item_lines, width
    )


def kitchen_ticket(
    orders: DataFrame, items: DataFrame, item_keys: list[str], paper: str = "80mm"
) -> DataFrame:
    """Lines of the kitchen ticket; prices are dropped before anything is rendered."""
    width = kitchen.PAPER_COLUMNS[paper]
    cooked = items.select(
        "order_id",
        *[k for k in item_keys if k != "order_id"],
        "item_name",
        "quantity",
        "special_instructions",
    )
    counted = (
        orders.select("order_id", "tracking_id", "hotel_name", "created_at")
        .join(kitchen.kitchen_totals(cooked), "order_id", "left")
        .withColumns(
            {
                "items": F.coalesce("items", F.lit(0)),
                "total_qty": F.coalesce("total_qty", F.lit(1)),
            }
        )
    )
    heavy, light = F.lit("=" * width), F.lit("-" * width)

    def label(prefix: str, value: Column) -> Column:
        return F.concat(F.lit(prefix), value)

    def said(value: str) -> Column:
        return F.lit(value)

    hotel = F.upper(F.coalesce(F.nullif(F.col("hotel_name"), F.lit("")), F.lit(KITCHEN_HOTEL)))
    head = F.array(
        heavy,
        centered(hotel, width),
        centered(F.lit("*** KITCHEN ORDER TICKET (KOT) ***"), width),
        heavy,
        label("TRACKING ID: ", F.trim("tracking_id")),
        label("ORDER REF:   ", F.trim(F.col("order_id").cast("string"))),
        label("LOGGED AT:   ", display_timestamp(F.col("created_at"))),
        said("STATION:     HOT & COLD PREP LINE"),
        light,
        said("QTY   FOOD / BEVERAGE ITEM"),
        light,
    )

    def lines_of(name: Column, quantity: Column, note: Column) -> Column:
        title = F.concat(F.lit("["), quantity.cast("string"), F.lit("x]  "), F.upper(name))
        instruction = F.concat(F.lit(">>> INSTRUCTION: "), note)
        return F.concat(
            F.array(title),
            wrapped(instruction, width, "     "),
            F.array(F.lit("")),
        )

    item_lines = lines_of(
        F.coalesce(F.nullif(F.col("item_name"), F.lit("")), F.lit("Special Item")),
        kitchen.charged_quantity(),
        F.nullif(F.col("special_instructions"), F.lit("")),
    )
    combo = lines_of(F.lit(KITCHEN_COMBO), F.lit(1), F.lit(KITCHEN_COMBO_NOTE))
    foot = F.array(
        light,
        label("TOTAL PREPARATION ITEMS: ", F.col("total_qty").cast("string")),
        said("STATUS: PENDING KITCHEN PREPARATION"),
        heavy,
        centered(F.lit("*** FOR KITCHEN USE ONLY - NO BILLING ***"), width),
        heavy,
        centered(F.lit("[CUT PAPER HERE]"), width),
        F.lit(FEED),
    )
    return _ticket(
        counted, cooked, item_keys, {HEAD: head, ITEMS: combo, FOOT: foot}, item_lines, width
    )


def ticket_of(lines: DataFrame, order_id: int, item_keys: list[str]) -> DataFrame:
    """The lines of one order's ticket in printing order."""
    return lines.where(F.col("order_id") == order_id).orderBy("block", *item_keys, "line").select("text")
