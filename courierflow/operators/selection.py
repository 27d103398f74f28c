"""Exact quantiles of columns with any number of distinct values.

Each wanted place in the order lies between two values. A sketch over the rows
between them proposes two values closer to it, and a count over all rows proves
where the place lies: below, at, between or above these. Once few rows are left
between, their values are counted and summed up in order. What a task holds is
bounded whatever the column holds, and a pass serves all columns and quantiles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HELD = 1_000_000  # values between two bounds that are put in order
ACCURACY = 10_000  # of a sketch: ranks are right to one part in this many


@dataclass
class Place:
    """A rank (from 0) in the order of a column, between two values or at one."""

    column: str
    rank: int
    inside: int  # rows between the bounds
    below: int = 0  # rows before those
    low: float | None = None  # both bounds lie outside; none: no bound
    high: float | None = None
    value: float | None = None  # when found

    def between(self) -> Column:
        """The column's values inside the bounds, else null."""
        value = F.col(self.column)
        bounds = [value.isNotNull()]
        bounds += [] if self.low is None else [value > F.lit(self.low)]
        bounds += [] if self.high is None else [value < F.lit(self.high)]
        return F.when(reduce(Column.__and__, bounds), value)

    def narrow(self, low: float, high: float, counts: tuple[int, int, int, int]) -> None:
        """Given the rows below ``low``, at it, between, and at ``high``."""
        ends = [sum(counts[: i + 1]) for i in range(4)]
        whole = self.below + self.inside
        if self.rank < ends[0]:
            self.high, self.inside = low, ends[0] - self.below
        elif self.rank < ends[1]:
            self.value = low
        elif self.rank < ends[2]:
            self.low, self.high, self.below, self.inside = low, high, ends[1], counts[2]
        elif self.rank < ends[3]:
            self.value = high
        else:
            self.low, self.below, self.inside = high, ends[3], whole - ends[3]


def _round(rows: DataFrame, places: list[Place], accuracy: int) -> None:
    """Two passes: values near each place from sketches, then their exact counts."""
    asked = []
    for p in places:
        middle = (p.rank - p.below + 0.5) / p.inside
        around = [F.lit(max(0.0, middle - 2 / accuracy)), F.lit(min(1.0, middle + 2 / accuracy))]
        asked.append(F.percentile_approx(p.between(), F.array(*around), accuracy))
    pairs = list(rows.agg(*asked).first())
    counts = []
    for p, (low, high) in zip(places, pairs):
        value = F.col(p.column)
        above = F.lit(high > low)  # equal bounds are counted once
        counts += [
            F.count_if(value < F.lit(low)),
            F.count_if(value == F.lit(low)),
            F.count_if((value > F.lit(low)) & (value < F.lit(high))),
            F.count_if((value == F.lit(high)) & above),
        ]
    found = rows.agg(*counts).first()
    for i, (p, (low, high)) in enumerate(zip(places, pairs)):
        p.narrow(low, high, tuple(found[4 * i : 4 * i + 4]))


def _settle(rows: DataFrame, places: list[Place]) -> None:
    """Put the few values left between the bounds of each place in order."""
    values = [F.struct(F.lit(i).alias("place"), F.lit(p.rank - p.below).alias("at"), p.between().alias("value")) for i, p in enumerate(places)]
    counted = (
        rows.select(F.inline(F.array(*values))).where("value is not null")
        .groupBy("place", "at", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    upto = Window.partitionBy("place").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = counted.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") > F.col("at")).groupBy("place").agg(F.min("value").alias("value"))
    for row in found.collect():  # one row a place
        places[row["place"]].value = row["value"]


def exact_quantiles(
    df: DataFrame, columns: list[str], points: list[float], held: int = HELD, accuracy: int = ACCURACY
) -> DataFrame:
    """column_name, point and value: quantiles as doubles by linear interpolation, exact at any number of values.

    Nulls and NaN are left out; a column without other values has null quantiles. The
    driver sees two values and four counts a column and point in each round. Each
    round leaves some 4 of ``accuracy`` rows between the bounds, so 10^12 rows take
    three, and ends earlier where a place falls on a repeated value.
    """
    number = [F.col(c).cast("double") for c in columns]
    rows = df.select(*[F.when(~F.isnan(x), x).alias(c) for x, c in zip(number, columns)])
    sizes = dict(zip(columns, rows.agg(*[F.count(c) for c in columns]).first()))
    places: dict[tuple[str, int], Place] = {}
    wanted = []
    for c in columns:
        for point in points:
            at = (sizes[c] - 1) * point
            ranks = (math.floor(at), math.ceil(at)) if sizes[c] else ()
            for rank in ranks:
                places.setdefault((c, rank), Place(c, rank, sizes[c]))
            wanted.append((c, float(point), ranks, at))
    while open_places := [p for p in places.values() if p.value is None and p.inside > held]:
        _round(rows, open_places, accuracy)
    if rest := [p for p in places.values() if p.value is None]:
        _settle(rows, rest)

    found = []
    for c, point, ranks, at in wanted:
        value = None
        if ranks:
            low, high = (places[c, rank].value for rank in ranks)
            value = low if low == high else low + (high - low) * (at - ranks[0])
        found.append((c, point, value))
    return df.sparkSession.createDataFrame(found, "column_name string, point double, value double")
