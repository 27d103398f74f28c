"""Counts of hashed values in a fixed number of buckets, summed over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_BITS = 13


def bucket_counts(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """How many of the hashes that ``hashes`` takes from a batch begin with each ``bits`` bits.

    Each task adds up one vector of 2**bits counters whatever its number of rows,
    and sends it in blocks; the tasks that own a block add the blocks up as they
    come. What reaches the driver is 2**bits numbers at every input size.
    """
    shift, size = np.uint64(64 - bits), 1 << bits
    narrow = [np.dtype(k) for k in (np.uint8, np.uint16, np.uint32, np.int64)]
    block = 1 << min(BLOCK_BITS, bits)

    def packed(row):
        kind = next(k for k in narrow if row.max(initial=0) <= np.iinfo(k).max)
        return row.astype(kind).tobytes()

    def unpacked(raw):
        return np.frombuffer(raw, narrow[(len(raw) // block).bit_length() - 1]).astype(np.int64)

    def count(batches):
        total = np.zeros(size, np.int64)
        held, waiting = [], 0
        for batch in batches:
            for h in hashes(batch):
                held.append((h >> shift).astype(np.int32))
                waiting += len(h)
                if waiting > 500_000:
                    total += np.bincount(np.concatenate(held), minlength=size)
                    held, waiting = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=size)
        rows = total.reshape(-1, block)
        full = np.flatnonzero(rows.any(axis=1))
        for part in np.array_split(full, max(1, len(full) // 64)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array([packed(rows[i]) for i in part], pa.binary())], ["block", "counts"]
            )

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = unpacked(counts)
                totals[i] = totals[i] + row if i in totals else row
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int32()), pa.array([packed(t) for t in totals.values()], pa.binary())],
            ["block", "counts"],
        )

    schema = "block int, counts binary"
    summed = df.mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)
    out = np.zeros((size // block, block), np.int64)
    for row in summed.collect():
        out[row["block"]] += unpacked(row["counts"])
    return out.reshape(-1)
