"""Tables kept in segments: arithmetic, amount of writing, repeated and missing batches."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from courierflow.session import work_path
from courierflow.sources import segments

SCHEMA = "id bigint, said bigint, value bigint"


def merge(known, news):
    both = known.unionByName(news)
    return both.groupBy("id").agg(F.max("said").alias("said"), F.max_by("value", "said").alias("value"))


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_segments_carry_like_a_counter(fan):
    written = 0
    for batches in range(1, 300):
        now = segments.current(batches, fan)
        assert now[0][0] == 0 and now[-1][1] == batches and all(a[1] == b[0] for a, b in zip(now, now[1:]))
        sizes = [b - a for a, b in now]
        assert sizes == sorted(sizes, reverse=True) and all(sizes.count(s) < fan for s in sizes)
        written += sizes[-1]
    # every batch's rows are written once for each power of fan up to the number of batches
    power, levels = 1, 0
    while power <= 299:
        power, levels = power * fan, levels + 1
    assert written <= 299 * levels


def test_any_number_of_batches_gives_the_last_word(spark):
    rng, path, last = random.Random(6), work_path(spark, "segments"), {}
    for batch in range(7):
        ids = rng.sample(range(100), 10)
        rows = [(i, batch * 100 + k, rng.randrange(1000)) for k, i in enumerate(ids)]
        df = spark.createDataFrame(rows, SCHEMA)
        segment = segments.append(df, path, batch, merge, fan=2)
        if batch == 3:  # the batch that merges all is repeated
            assert segment == (0, 4) == segments.append(df, path, batch, merge, fan=2)
        if batch % 2 == 0:  # no other batch's rows are touched
            assert spark.read.parquet(segments._path(path, segment)).count() == 10
        last |= {i: v for i, _, v in rows}
        table = segments.read(spark, path, batch + 1, merge, fan=2)
        assert {r["id"]: r["value"] for r in table.collect()} == last


def test_a_missing_segment_is_noticed(spark):
    path = work_path(spark, "segments")
    df = spark.createDataFrame([(1, 1, 1)], SCHEMA)
    segments.append(df, path, 0, merge, fan=2)
    assert segments.read(spark, path, 2, merge, fan=2) is None and segments.read(spark, path, 0, merge) is None
    with pytest.raises(AnalysisException):
        segments.append(df, path, 3, merge, fan=2)
