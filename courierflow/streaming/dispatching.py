"""Dispatch creation over a stream of order requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def start_dispatching(
    requests: DataFrame,
    create: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Create the dispatches of every micro-batch and append them to a table.

    ``create`` turns requests into dispatch orders against the fleet and weather
    as they are when the batch runs. Batch n writes folder n, so a repeated batch
    replaces its own rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        create(batch).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
