"""A keyed table kept from batches of news, in segments that are merged as a counter carries.

Batch n writes a segment of its own rows. Where ``fan`` divides the number of batches,
the last ``fan`` segments of one size become one, and so on for its powers. So a batch
usually writes no more than its news, a row is written again once for each power of ``fan``, and a
reader merges fewer than ``fan`` segments of each size. Which segments are current follows
from the number of batches alone; a repeated batch writes its own segment again. Segments
that a larger one replaced may be removed once no reader is on an older count.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

FAN = 8
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def current(batches: int, fan: int = FAN) -> list[tuple[int, int]]:
    """The segments, as ranges of batches, that make up the table after so many batches; the oldest first."""
    found, at = [], 0
    while at < batches:
        size = 1
        while size * fan <= batches - at:
            size *= fan
        found.append((at, at + size))
        at += size
    return found


def _path(path: str, segment: tuple[int, int]) -> str:
    return f"{path}/segment={segment[0]:012d}-{segment[1]:012d}"


def _read(spark: SparkSession, path: str, segments: list[tuple[int, int]]) -> list[DataFrame]:
    return [spark.read.parquet(_path(path, s)) for s in segments]


def append(news: DataFrame, path: str, batch: int, merge: Merge, fan: int = FAN) -> tuple[int, int]:
    """Write batch number ``batch`` (from 0) and return the segment that holds it.

    ``merge`` makes one row a key of two tables and may be applied in any order. Batches come in
    order: a missing segment is an error, not an empty table.
    """
    segment = current(batch + 1, fan)[-1]
    older = [s for s in current(batch, fan) if s[0] >= segment[0]]
    parts = [*_read(news.sparkSession, path, older), news]
    whole = merge(reduce(DataFrame.unionByName, parts[:-1]), news) if older else news
    whole.write.mode("overwrite").parquet(_path(path, segment))
    return segment


def read(spark: SparkSession, path: str, batches: int, merge: Merge, fan: int = FAN) -> DataFrame | None:
    """The table after so many batches; None if a segment of it was never written."""
    try:
        parts = _read(spark, path, current(batches, fan))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise
    if not parts:
        return None
    return merge(reduce(DataFrame.unionByName, parts[:-1]), parts[-1]) if len(parts) > 1 else parts[0]
