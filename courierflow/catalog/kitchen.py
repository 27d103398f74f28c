"""MU5, MU6, AG6, AG7, TK*: kitchen queue, bills and tickets."""

from __future__ import annotations

from pyspark.sql import functions as F

from courierflow.catalog.base import py_round_sql, query
from courierflow.operators import kitchen, tickets
from courierflow.sources.binding import Tables

ITEM_KEYS = ["line_no", "item_id", "station_id"]

ORDER_HEADS_SQL = """
select d.id as order_id, tracking_id, hotel_name,
  case when d.id % 5 <> 0 then 'Client ' || d.id end as client_name,
  case when d.id % 7 <> 0 then '+1 555 ' || d.id else '' end as client_phone,
  case when d.id % 11 <> 0 then coalesce(hotel_name, 'x') || ' Street ' || d.id || ', Block ' || d.hotel_id
    || ', Flat ' || dispatch_attempts || ' near the old market gate beside the river promenade' end as client_address,
  strftime(created_at, '%Y-%m-%dT%H:%M:%S') as created_at,
  case d.id % 4 when 0 then 0.0e0 when 1 then null else 2.25e0 end as delivery_fee,
  case d.id % 3 when 0 then 0.0e0 when 1 then null else 0.04e0 end as tax_rate
from dispatch_orders d join hotels using (hotel_id)
"""


def order_heads(t: Tables):
    """Dispatch orders with made-up client details, fee and tax rate."""
    key = F.col("id")
    address = F.concat(
        "hotel_name",
        F.lit(" Street "),
        key,
        F.lit(", Block "),
        "hotel_id",
        F.lit(", Flat "),
        "dispatch_attempts",
        F.lit(" near the old market gate beside the river promenade"),
    )
    return t.dispatch_orders.join(t.hotels.select("hotel_id", "hotel_name"), "hotel_id").select(
        key.alias("order_id"),
        "tracking_id",
        "hotel_name",
        F.when(key % 5 != 0, F.concat(F.lit("Client "), key)).alias("client_name"),
        F.when(key % 7 != 0, F.concat(F.lit("+1 555 "), key)).otherwise("").alias("client_phone"),
        F.when(key % 11 != 0, address).alias("client_address"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        F.when(key % 4 == 0, 0.0).when(key % 4 != 1, 2.25).alias("delivery_fee"),
        F.when(key % 3 == 0, 0.0).when(key % 3 != 1, 0.04).alias("tax_rate"),
    )


def queue_items(t: Tables):
    """Normalized items of known orders."""
    return kitchen.normalize_items(t.kitchen_queue)


ITEMS_SQL = """
select order_id, line_no, item_id, station_id, trim(item_name) as item_name, greatest(1, quantity) as quantity, unit_price,
  nullif(trim(special_instructions), '') as special_instructions,
  case raw_status when 'completed' then 'Completed' when 'READY' then 'Ready' else 'Pending' end as status
from kitchen_queue
"""
BILLS_SQL = """
select *, round(subtotal + fee + tax, 2) as total from (
  select h.*, coalesce(n, 0) as items, round(coalesce(s, 18.5e0), 2) as subtotal,
    coalesce(nullif(delivery_fee, 0), 3.5e0) as fee, {tax} as tax
  from heads h left join (select order_id, count(*) as n, sum(quantity * coalesce(nullif(unit_price, 0), {price})) as s
    from item_rows group by order_id) b using (order_id))
""".replace(
    "{tax}", py_round_sql("(round(coalesce(s, 18.5e0), 2) * coalesce(nullif(tax_rate, 0), 0.08e0))", 2)
)

STATUS_EVENTS_SQL = """
select event_id, ts, order_no as order_id, 1 + rider_id % 7 as line_no, event_id % 2 as single,
  case action when 'ACTIVATE' then 'preparing' when 'COMPLETE' then 'READY' when 'STATUS' then 'completed' else 'lost' end as status
from dispatch_events
"""


def status_events(t: Tables):
    said = (
        F.when(F.col("action") == "ACTIVATE", "preparing")
        .when(F.col("action") == "COMPLETE", "READY")
        .when(F.col("action") == "STATUS", "completed")
        .otherwise("lost")
    )
    return t.dispatch_events.select(
        "event_id",
        "ts",
        F.col("order_no").alias("order_id"),
        (F.col("rider_id") % 7 + 1).cast("int").alias("line_no"),
        (F.col("event_id") % 2).alias("single"),
        said.alias("status"),
    )


def statuses(t: Tables):
    events = status_events(t)
    return kitchen.apply_status_events(
        queue_items(t),
        events.where("single = 1").drop("single"),
        events.where("single = 0").drop("single", "line_no"),
        ["order_id", "line_no"],
        "order_id",
    ).select("order_id", *ITEM_KEYS, "status", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


def wrap_sql(text: str, width: int, indent: str) -> str:
    """SQL: greedy word wrap of ``text`` into a list of padded lines; null gives no lines."""
    words = f"regexp_split_to_array(trim({text}), '\\s+')"
    body = (
        f"list_reduce(list_concat(['{indent}' || {words}[1]], {words}[2:]), lambda a, w: "
        f"case when len(split_part(a, chr(10), -1)) + 1 + len(w) <= {width} then a || ' ' || w "
        f"else a || chr(10) || '{indent}' || w end)"
    )
    return (
        f"case when {text} is null then [] else list_transform(string_split({body}, chr(10)), "
        f"lambda x: rpad(x, greatest({width}, len(x))::int, ' ')) end"
    )


def pad(text: str, width: int) -> str:
    return f"rpad({text}, greatest({width}, len({text}))::int, ' ')"


def left(text: str, width: int) -> str:
    return f"lpad({text}, greatest({width}, len({text}))::int, ' ')"


def mid(text: str, width: int) -> str:
    padded = f"(repeat(' ', greatest(0, {width} - len({text})) // 2) || {text})"
    return pad(padded, width)


def usd(value: str) -> str:
    return f"printf('$%.2f', cast({value} as double))"


def numbered(block: int, lines: str, source: str, keys: str) -> str:
    return (
        f"select order_id, {keys}, {block} as block, cast(unnest(range(len(lines))) as int) as line, unnest(lines) as text "
        f"from (select *, {lines} as lines from {source})"
    )


NO_KEYS = "null::int as line_no, null::bigint as item_id, null::bigint as station_id"
KEYS = "line_no, item_id, station_id"


def receipt_sql(paper: str) -> dict[str, str]:
    w = kitchen.PAPER_COLUMNS[paper]
    price = f"{kitchen.FALLBACK_PRICE[paper]}e0"
    heavy, light = f"repeat('=', {w})", f"repeat('-', {w})"
    columns = "ITEM             QTY       TOTAL" if w <= 36 else "ITEM DESCRIPTION        QTY   PRICE    TOTAL"

    def cells(name: str, qty: str, amount: str) -> str:
        total = usd(f"{qty} * {amount}")
        count = left(f"cast({qty} as varchar)", 3)
        if w <= 36:
            made = f"rpad({name}, 16, ' ') || ' ' || {count} || ' ' || {left(total, 11)}"
        else:
            made = f"rpad({name}, 22, ' ') || ' ' || {count} || ' ' || {left(usd(amount), 8)} || ' ' || {left(total, 8)}"
        return pad(f"({made})", w)

    def bill(name: str, value: str) -> str:
        text = usd(value)
        return f"'{name}' || repeat(' ', greatest(1, {w - len(name)} - len({text}))) || {text}"

    def label(prefix: str, value: str) -> str:
        return pad(f"('{prefix}' || {value})", w)

    head = f"""list_concat([{heavy}, {mid('upper(hotel_name)', w)}, {mid("'DELIVERY RECEIPT & DISPATCH TICKET'", w)}, {heavy},
      {label('TRACKING ID: ', 'tracking_id')}, {label('ORDER ID:    ', 'cast(order_id as varchar)')},
      {label('DATE/TIME:   ', "replace(created_at, 'T', ' ')")}, {light}, {pad("'CUSTOMER DISPATCH DETAILS:'", w)},
      {label('Name:    ', "coalesce(client_name, 'Valued Customer')")},
      {label('Phone:   ', "coalesce(nullif(client_phone, ''), 'N/A')")}, {pad("'Address:'", w)}],
      {wrap_sql("coalesce(client_address, 'Customer Address')", w, '  ')}, [{light}, {pad(f"'{columns}'", w)}, {light}])"""
    charge = f"coalesce(nullif(unit_price, 0), {price})"
    prefix = "* " if w <= 36 else "* Note: "
    item = f"list_concat([{cells('item_name', 'quantity', charge)}], {wrap_sql(f'({chr(39)}{prefix}{chr(39)} || special_instructions)', w, '  ')})"
    combo = f"[{cells(chr(39) + tickets.RECEIPT_COMBO + chr(39), '1', '18.5e0')}]"
    foot = f"""[{light}, {bill('Subtotal:', 'subtotal')}, {bill('Delivery Fee:', 'fee')}, {bill('Sales Tax:', 'tax')}, {light},
      {bill('TOTAL BILL:', 'total')}, {heavy}, {mid("'Thank you for your order!'", w)},
      {mid("'Fast & Fresh Delivery Guaranteed'", w)}, {heavy}, {mid("'[CUT PAPER HERE]'", w)}, chr(10) || chr(10)]"""
    return {
        "sql": " union all ".join(
            [
                numbered(0, head, "bills", NO_KEYS),
                numbered(1, combo, "(select * from bills where items = 0)", NO_KEYS),
                numbered(2, foot, "bills", NO_KEYS),
                numbered(1, item, "item_rows", KEYS),
            ]
        ),
        "heads": ORDER_HEADS_SQL,
        "item_rows": ITEMS_SQL,
        "bills": BILLS_SQL.replace("{price}", price),
    }


def kot_sql(paper: str) -> dict[str, str]:
    w = kitchen.PAPER_COLUMNS[paper]
    heavy, light = f"repeat('=', {w})", f"repeat('-', {w})"

    def label(prefix: str, value: str) -> str:
        return pad(f"('{prefix}' || {value})", w)

    head = f"""[{heavy}, {mid('upper(hotel_name)', w)}, {mid("'*** KITCHEN ORDER TICKET (KOT) ***'", w)}, {heavy},
      {label('TRACKING ID: ', 'tracking_id')}, {label('ORDER REF:   ', 'cast(order_id as varchar)')},
      {label('LOGGED AT:   ', "replace(created_at, 'T', ' ')")}, {pad("'STATION:     HOT & COLD PREP LINE'", w)}, {light},
      {pad("'QTY   FOOD / BEVERAGE ITEM'", w)}, {light}]"""

    def lines(name: str, qty: str, note: str) -> str:
        title = pad(f"('[' || {qty} || 'x]  ' || upper({name}))", w)
        return f"list_concat([{title}], {wrap_sql(f'({chr(39)}>>> INSTRUCTION: {chr(39)} || {note})', w, '     ')}, [''])"

    foot = f"""[{light}, {label('TOTAL PREPARATION ITEMS: ', 'cast(total_qty as varchar)')},
      {pad("'STATUS: PENDING KITCHEN PREPARATION'", w)}, {heavy}, {mid("'*** FOR KITCHEN USE ONLY - NO BILLING ***'", w)},
      {heavy}, {mid("'[CUT PAPER HERE]'", w)}, chr(10) || chr(10)]"""
    combo = lines(f"'{tickets.KITCHEN_COMBO}'", "1", f"'{tickets.KITCHEN_COMBO_NOTE}'")
    return {
        "sql": " union all ".join(
            [
                numbered(0, head, "counted", NO_KEYS),
                numbered(1, combo, "(select * from counted where n is null)", NO_KEYS),
                numbered(2, foot, "counted", NO_KEYS),
                numbered(1, lines("item_name", "quantity", "special_instructions"), "item_rows", KEYS),
            ]
        ),
        "heads": ORDER_HEADS_SQL,
        "item_rows": ITEMS_SQL,
        "counted": """select h.*, n, coalesce(q, 1) as total_qty from heads h left join (
          select order_id, count(*) as n, cast(sum(quantity) as bigint) as q from item_rows group by order_id) using (order_id)""",
    }


def _receipt(paper: str):
    return query(
        f"tk1_delivery_ticket_{paper}",
        lambda t: tickets.delivery_ticket(order_heads(t), queue_items(t), ITEM_KEYS, paper),
        **receipt_sql(paper),
    )


def _kot(paper: str):
    return query(
        f"tk2_kitchen_ticket_{paper}",
        lambda t: tickets.kitchen_ticket(order_heads(t), queue_items(t), ITEM_KEYS, paper),
        **kot_sql(paper),
    )


QUERIES = [
    query(
        "mu5_normalize_items",
        lambda t: queue_items(t).select(
            "order_id", *ITEM_KEYS, "item_name", "quantity", "unit_price", "special_instructions", "status"
        ),
        "select order_id, line_no, item_id, station_id, item_name, quantity, unit_price, special_instructions, status from item_rows",
        item_rows=ITEMS_SQL,
    ),
    query(
        "mu6_kitchen_statuses",
        statuses,
        """select order_id, line_no, item_id, station_id, coalesce(case when later = 'i' then i_status else o_status end, status) as status,
        strftime(case when later = 'i' then i_ts else o_ts end, '%Y-%m-%d %H:%M:%S') as updated_at from (
          select k.*, i.status as i_status, o.status as o_status, i.ts as i_ts, o.ts as o_ts,
            case when o.ts is null or (i.ts is not null and (i.ts, i.event_id) > (o.ts, o.event_id)) then 'i' else 'o' end as later
          from item_rows k
          left join (select * from valid_events where single = 1 qualify row_number() over (partition by order_id, line_no order by ts desc, event_id desc) = 1) i
            on i.order_id = k.order_id and i.line_no = k.line_no
          left join (select * from valid_events where single = 0 qualify row_number() over (partition by order_id order by ts desc, event_id desc) = 1) o
            on o.order_id = k.order_id)""",
        item_rows=ITEMS_SQL,
        status_events=STATUS_EVENTS_SQL,
        valid_events="""select * replace (upper(left(status, 1)) || lower(substr(status, 2)) as status) from status_events where status <> 'lost'""",
    ),
    query(
        "mu6_rejected_statuses",
        lambda t: kitchen.reject_status_events(status_events(t)).select("event_id", "order_id", "status"),
        "select event_id, order_id, status from status_events where status = 'lost'",
        status_events=STATUS_EVENTS_SQL,
    ),
    query(
        "ag6_order_bills",
        lambda t: kitchen.order_bills(order_heads(t), queue_items(t)).select(
            "order_id", "items", "subtotal", "delivery_fee", "tax", "total"
        ),
        "select order_id, items, subtotal, fee as delivery_fee, tax, total from bills",
        heads=ORDER_HEADS_SQL,
        item_rows=ITEMS_SQL,
        bills=BILLS_SQL.replace("{price}", "14.5e0"),
    ),
    query(
        "ag7_kitchen_totals",
        lambda t: kitchen.kitchen_totals(queue_items(t)),
        "select order_id, count(*) as items, cast(sum(quantity) as bigint) as total_qty from item_rows group by order_id",
        item_rows=ITEMS_SQL,
    ),
    query(
        "ag7_kitchen_items",
        lambda t: kitchen.kitchen_items(queue_items(t), ["order_id", *ITEM_KEYS]),
        "select order_id, line_no, item_id, station_id, item_name, quantity, special_instructions, status from item_rows",
        item_rows=ITEMS_SQL,
    ),
    _receipt("80mm"),
    _receipt("58mm"),
    _kot("80mm"),
    _kot("58mm"),
]
