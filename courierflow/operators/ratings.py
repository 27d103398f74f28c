"""Rider ratings after a sequence of completions.

Each completion moves the rating by 0.05 and rounds it to one decimal, so a
rating is a state on the tenths up to 5.0 and a run of completions is a function
from state to state. Functions of consecutive runs compose: rows are sorted by
rider and time over range partitions, every partition reduces its runs to one
small table, and the tables are chained per rider. A rider with any number of
completions is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierflow.functions.rounding import py_round
from courierflow.functions.scalars import or_default

# Step, ceiling and the rating of an unrated rider.
STEP = 0.05
CEILING = 5.0
UNRATED = 4.8

# States are tenths. 0.2 holds itself, so ratings from 1.0 up never get below it.
LOWEST, HIGHEST = 2, 50


def _moved(tenths: int, on_time: bool) -> int:
    if tenths < LOWEST:
        return tenths
    rating = round(tenths / 10 + (STEP if on_time else -STEP), 1)
    return round(min(CEILING, rating) * 10)


MOVES = np.array([[_moved(s, up) for s in range(HIGHEST + 1)] for up in (False, True)])

_RUN_SCHEMA = (
    "rider_id bigint, first_ts timestamp, first_id bigint, first_on_time int, later array<int>"
)


def _composed(tables: np.ndarray, run: np.ndarray) -> np.ndarray:
    """One table per run, from the tables of its rows in order.

    Neighbours are composed in pairs, all runs at once, until one is left of each,
    so the number of steps grows with the logarithm of the longest run.
    """
    while True:
        second = (np.arange(len(run)) - np.searchsorted(run, run)) % 2 == 1
        right = np.flatnonzero(second)
        if not len(right):
            return tables
        tables[right - 1] = np.take_along_axis(tables[right], tables[right - 1].astype(np.intp), axis=1)
        tables, run = tables[~second], run[~second]


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per rider's run in a sorted partition: its first event, and the rest as a table."""
    carried: pd.DataFrame | None = None  # the run that the rows so far end with
    for batch in batches:
        if not len(batch):
            continue
        riders = batch["rider_id"].to_numpy()
        starts = np.r_[True, riders[1:] != riders[:-1]]
        tables = MOVES[batch["was_on_time"].to_numpy(dtype=np.int64)].astype(np.int32)
        goes_on = carried is not None and carried["rider_id"].iat[0] == riders[0]
        heads = np.flatnonzero(starts)
        tables[heads[1:] if goes_on else heads] = np.arange(HIGHEST + 1)  # the first event is told apart
        later = _composed(tables, np.cumsum(starts) - 1)
        first = batch.iloc[heads]
        runs = pd.DataFrame(
            {
                "rider_id": first["rider_id"].to_numpy(),
                "first_ts": first["ts"].to_numpy(),
                "first_id": first["id"].to_numpy(),
                "first_on_time": first["was_on_time"].astype("int32").to_numpy(),
                "later": list(later),
            }
        )
        if goes_on:
            runs.at[0, "later"] = later[0][carried["later"].iat[0]]
            for name in ("first_ts", "first_id", "first_on_time"):
                runs.loc[0, name] = carried[name].iat[0]
        elif carried is not None:
            yield carried
        carried = runs.iloc[-1:].reset_index(drop=True)
        if len(runs) > 1:
            yield runs.iloc[:-1]
    if carried is not None:
        yield carried


def rating_runs(completed: DataFrame) -> DataFrame:
    """Runs of completions (rider_id, ts, id, was_on_time) per rider and partition."""
    order = ["rider_id", "ts", "id"]
    placed = completed.select(*order, "was_on_time").where("rider_id is not null")
    return (
        placed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInPandas(_runs, _RUN_SCHEMA)
    )


def updated_ratings(riders: DataFrame, completed: DataFrame) -> DataFrame:
    """Riders with their rating after all completions in (ts, id) order.

    A rider has at most one run per partition, so the chained list is short.
    """
    run = F.struct("first_ts", "first_id", "first_on_time", "later")
    chained = (
        rating_runs(completed)
        .groupBy(F.col("rider_id").alias("id"))
        .agg(F.sort_array(F.collect_list(run)).alias("_runs"))
    )
    moves = [F.array(*[F.lit(int(s)) for s in MOVES[up]]) for up in (0, 1)]

    def after(run: Column, state: Column) -> Column:
        return F.get(run["later"], state)

    def chain(state: Column, run: Column) -> Column:
        first = F.when(run["first_on_time"] == 1, F.get(moves[1], state)).otherwise(
            F.get(moves[0], state)
        )
        return after(run, first)

    rating = or_default(F.col("rating"), UNRATED)
    head = F.get("_runs", F.lit(0))
    step = F.when(head["first_on_time"] == 1, STEP).otherwise(-STEP)
    # The stored rating may lie between tenths; the first step brings it onto them.
    entered = F.least(F.lit(CEILING), py_round(rating + step, 1))
    start = after(head, F.rint(entered * 10).cast("int"))
    rest = F.slice("_runs", F.lit(2), F.size("_runs"))
    final = F.aggregate(rest, start, chain).cast("double") / 10.0
    return (
        riders.join(chained, "id", "left")
        .withColumn("rating", F.when(F.col("_runs").isNotNull(), final).otherwise(F.col("rating")))
        .drop("_runs")
    )
