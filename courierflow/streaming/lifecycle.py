"""Order life cycle over an event stream, with the five-minute response timer.

Events may arrive in any order within the watermark's delay. They wait in the
order's state until the watermark has passed them and are then applied in
(time, id) order, so the result does not depend on how they were batched. A closed
order is remembered for CLOSED_DAYS and ignores events in that time; a dispatch
after it starts a new life. The batch replay applies the same rules to a stored log.

Events that arrive behind the watermark are not applied, as the order has moved on,
and not lost either: they leave the operator as late rows, into a partition of their own,
so the stream's rows are the replay of the log without the late ones.

Offers that nobody answers run out every five minutes, as often as the hotel has couriers,
so most events are such expiries. The state function gives them as runs, one row for
consecutive expiries; ``expanded`` makes the single events of them in Spark.
"""

from __future__ import annotations

import bisect
import json
import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from courierflow import domain as D
from courierflow.session import written

MINUTE = 60_000_000
RESPONSE = D.RESPONSE_MINUTES * MINUTE
CLOSED_DAYS = 30
OUTPUT_SCHEMA = (
    "order_id bigint, event_type string, attempt int, at timestamp, duration_min double"
)
# The same, where a row stands for so many events of consecutive attempts, five minutes apart.
RUN_SCHEMA = OUTPUT_SCHEMA + ", offers bigint"
STATE_SCHEMA = "lives string"
INPUT = ["order_id", "ts", "event_id", "action", "candidates"]
# What the stream gives: runs of life-cycle events, and late input events with their id, action, time and candidates.
STREAM_SCHEMA = RUN_SCHEMA + ", event_id bigint, late boolean"
# Orders share this many states, so that a call of the state function serves many orders. Fixed for a checkpoint.
PAGES = 2048
# Spark drops rows behind the watermark by the column that has this metadata; a time that is never behind keeps them.
WATERMARKED = {"spark.watermarkDelayMs": 0}
NEVER_LATE = "2200-01-01"


class Life:
    """One order: its status, current attempt, offer expiry and activation time."""

    def __init__(self, saved: dict[str, Any] | None = None):
        saved = saved or {}
        self.status = saved.get("status")
        self.attempt = saved.get("attempt", 0)
        self.candidates = saved.get("candidates", 0)
        self.expires = saved.get("expires")
        self.started = saved.get("started")
        self.closed_at = saved.get("closed_at")
        self.waiting = saved.get("waiting", [])

    @property
    def closed(self) -> bool:
        return self.status in (D.DELIVERED, D.UNASSIGNED)

    @property
    def forgotten_at(self) -> int | None:
        return self.closed_at + CLOSED_DAYS * 24 * 60 * MINUTE if self.closed else None

    def _close(self, status: str, at: int) -> None:
        self.status, self.expires, self.closed_at = status, None, at

    def _offer_next(self, kind: str, at: int, offers: int = 1) -> tuple:
        if self.attempt >= self.candidates:
            self._close(D.UNASSIGNED, at)
            return ("CASCADE_EXHAUSTED", self.attempt, at, None, 1)
        row = (kind, self.attempt, at, None, offers)
        self.attempt += offers
        self.expires = at + offers * RESPONSE
        return row

    def _apply(self, at: int, action: str, candidates: int) -> list[tuple]:
        if self.closed and at >= self.forgotten_at:
            self.__init__({"waiting": self.waiting})
        if self.status is None:
            if action != "DISPATCH_TRIGGERED":
                return []
            self.candidates, self.started = candidates, at
            if candidates < 1:
                self._close(D.UNASSIGNED, at)
                return [("DISPATCH_TRIGGERED", 0, at, None, 1)]
            self.status, self.attempt = D.PENDING, 1
            self.expires = at + RESPONSE
            return [("DISPATCH_TRIGGERED", 1, at, None, 1)]
        if action == "ACTIVATE" and self.status == D.PENDING:
            self.status, self.expires, self.started = D.ACTIVE, None, at
            return [("ORDER_ACTIVATED", self.attempt, at, None, 1)]
        if action == "DEACTIVATE" and self.status == D.PENDING:
            return [self._offer_next("ORDER_DEACTIVATED", at)]
        if action == "COMPLETE" and not self.closed:
            minutes = max(1.0, round((at - self.started) / MINUTE, 1))
            self._close(D.DELIVERED, at)
            return [("ORDER_COMPLETED", self.attempt, at, minutes, 1)]
        return []

    def _expire(self, until: int) -> list[tuple]:
        rows = []
        while self.status == D.PENDING and self.expires <= until:
            passed, left = (until - self.expires) // RESPONSE + 1, self.candidates - self.attempt
            offers = int(left) if left < passed else passed
            rows.append(self._offer_next("TIMEOUT_EXPIRED", self.expires, offers))
        return rows

    def step(self, at: int, action: str, candidates: int) -> list[tuple]:
        """Apply one event after the offers that expired up to its time."""
        return [*self._expire(at), *self._apply(at, action, candidates)]

    def advance(self, until: int) -> list[tuple]:
        """Apply waiting events and expiries up to a time, in order."""
        self.waiting.sort()
        due = bisect.bisect_left(self.waiting, [until + 1])
        ready, self.waiting = self.waiting[:due], self.waiting[due:]
        rows = []
        for at, _, action, candidates in ready:
            rows += self.step(at, action, candidates)
        return [*rows, *self._expire(until)]

    def next_time(self) -> int | None:
        times = [w[0] for w in self.waiting[:1]]
        if self.status == D.PENDING:
            times.append(self.expires)
        if self.closed:
            times.append(self.forgotten_at)
        return min(times, default=None)


def _micros(ts: pd.Series) -> list[int]:
    utc = pd.to_datetime(ts)
    if utc.dt.tz is not None:
        utc = utc.dt.tz_convert("UTC").dt.tz_localize(None)
    return utc.astype("datetime64[us]").astype("int64").tolist()


def _frame(rows: list[tuple], *more: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["order_id", "event_type", "attempt", "at", "duration_min", "offers", *more])
    # pandas would make floats of ids beside nulls
    out["order_id"] = pd.array([None if row[0] is None or row[0] != row[0] else int(row[0]) for row in rows], dtype="Int64")
    out["at"] = pd.to_datetime(out["at"].astype("int64"), unit="us")
    out["duration_min"] = out["duration_min"].astype("float64")
    return out


def _number(text: str | None) -> int | float:
    return math.nan if text is None else int(text)


def _on_batch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One page of orders: new events wait in their order's life, lives that are due move on."""
    watermark = max(0, state.getCurrentWatermarkMs())
    page = {order: (due, life) for order, due, life in json.loads(state.get[0])} if state.exists else {}
    new: dict[int | None, list[list]] = {}
    late = []
    for frame in frames:
        for order, at, event_id, action, candidates in zip(
            *(frame[c].tolist() for c in ("order_text", "micros", "event_text", "action", "candidates"))
        ):
            order, event_id = None if order is None else int(order), _number(event_id)
            if at <= watermark * 1000:
                late.append((order, action, candidates, int(at), None, 1, event_id, True))
            else:
                new.setdefault(order, []).append([at, event_id, action, candidates])
    rows = []
    touched = {order for order, (due, _) in page.items() if due is not None and due <= watermark * 1000}
    for order in touched | new.keys():
        life = Life(page.pop(order, (None, None))[1])
        life.waiting += new.get(order, [])
        rows += [(order, *row, None, False) for row in life.advance(watermark * 1000)]
        due = life.next_time()
        forgotten = life.closed and not life.waiting and life.forgotten_at <= watermark * 1000
        if not forgotten and (life.status is not None or due is not None):
            page[order] = (due, life.__dict__)
    if page:
        state.update((json.dumps([(order, due, life) for order, (due, life) in page.items()]),))
        next_due = min((due for due, _ in page.values() if due is not None), default=None)
        if next_due is not None:
            state.setTimeoutTimestamp(max(int(next_due) // 1000 + 1, watermark + 1))
    elif state.exists:
        state.remove()
    if rows or late:
        out = _frame([*rows, *late], "event_id", "late")
        out["event_id"] = pd.array([None if row[6] is None or row[6] != row[6] else row[6] for row in [*rows, *late]], dtype="Int64")
        yield out


def lifecycle_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Runs of life-cycle events of a stream of (order_id, ts, event_id, action, candidates), and its late rows.

    ``candidates`` is the number of couriers an order can be offered to; attempt
    k goes to the hotel's k-th courier, which a join with the ranking resolves.
    A row whose time the watermark has passed when it arrives is not applied and comes
    out as it is, with ``late`` true. Orders are dealt to ``PAGES`` states by their hash.
    """
    # ids travel as text: pandas would make floats of numbers beside nulls
    never = F.lit(NEVER_LATE).cast("timestamp").alias("kept", metadata=WATERMARKED)
    timed = events.select(*INPUT).withWatermark("ts", delay)
    return (
        timed.select(
            F.pmod(F.xxhash64("order_id"), F.lit(PAGES)).cast("int").alias("page"),
            F.col("order_id").cast("string").alias("order_text"),
            F.unix_micros("ts").alias("micros"),
            F.col("event_id").cast("string").alias("event_text"),
            "action",
            "candidates",
            never,
        )
        .groupBy("page")
        .applyInPandasWithState(
            _on_batch, STREAM_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout
        )
        # the operator's columnar rows have to be copied before the sink sorts them by partition
        .withColumn("late", F.coalesce("late", F.lit(False)))
    )


def start_lifecycle(events: DataFrame, path: str, checkpoint: str, delay: str) -> StreamingQuery:
    """Append the runs of life-cycle events and late rows to a table, reading all that is available."""
    return (
        lifecycle_stream(events, delay)
        .writeStream.format("parquet")
        .partitionBy("late")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def read_lifecycle(spark: SparkSession, path: str) -> DataFrame:
    """The life-cycle events of a table that ``start_lifecycle`` keeps."""
    return expanded(read_runs(spark, path))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The runs of life-cycle events of such a table, as they are stored."""
    found = spark.read.schema(STREAM_SCHEMA).parquet(path)
    return found.where("not late").drop("event_id", "late")


def expanded(runs: DataFrame) -> DataFrame:
    """Single life-cycle events: a run's attempts follow each other every five minutes."""
    each = runs.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("offers") - 1)))
    return each.withColumns(
        {
            "attempt": (F.col("attempt") + F.col("_step")).cast("int"),
            "at": F.timestamp_micros(F.unix_micros("at") + F.col("_step") * RESPONSE),
        }
    ).drop("offers", "_step")


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """order_id, ts, event_id, action and candidates of the events that came too late to be applied."""
    return spark.read.schema(STREAM_SCHEMA).parquet(path).where("late").select(
        "order_id", F.col("at").alias("ts"), "event_id", F.col("event_type").alias("action"), F.col("attempt").alias("candidates")
    )


def replay(events: DataFrame, as_of: str) -> DataFrame:
    """The same life-cycle events from a stored log, as known at ``as_of``."""
    return expanded(replay_runs(events, as_of))


def replay_runs(events: DataFrame, as_of: str) -> DataFrame:
    """Runs of life-cycle events from a stored log, as known at ``as_of``.

    Orders are sorted within partitions and read as a stream of rows; only the
    order at hand is held, never its list of events.
    """
    until = int(pd.Timestamp(as_of).value // 1000)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order, life = None, Life()
        for batch in batches:
            rows = []
            columns = (batch["order_id"], batch["action"], batch["candidates"])
            for at, order_id, action, candidates in zip(_micros(batch["ts"]), *(c.tolist() for c in columns)):
                if order_id != order:
                    rows += [(order, *r) for r in life.advance(until)]
                    order, life = order_id, Life()
                rows += [(order, *r) for r in life.step(at, action, candidates)]
            if rows:
                yield _frame(rows)
        rows = [(order, *r) for r in life.advance(until)]
        if rows:
            yield _frame(rows)

    sorting = ["order_id", "ts", "event_id"]
    return (
        events.select(*INPUT)
        .where(F.col("ts") <= F.lit(as_of).cast("timestamp"))
        .where(F.col("action").isin("DISPATCH_TRIGGERED", "ACTIVATE", "DEACTIVATE", "COMPLETE"))
        .repartition("order_id")
        .sortWithinPartitions(*sorting)
        .mapInPandas(fold, RUN_SCHEMA)
    )


def with_couriers(runs: DataFrame, ranked: DataFrame, order_hotels: DataFrame) -> DataFrame:
    """Single life-cycle events with the courier each attempt was offered to.

    Runs meet their hotel before they are expanded. The ranking is small beside the
    events: as a written table its size is known, so Spark broadcasts it where it fits.
    """
    offered = ranked.select("hotel_id", F.col("rank").alias("attempt"), F.col("id").alias("rider_id"))
    placed = expanded(runs.join(order_hotels, "order_id", "left"))
    return placed.join(written(offered, "ranked"), ["hotel_id", "attempt"], "left")
