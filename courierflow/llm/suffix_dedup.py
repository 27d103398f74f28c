"""Removal of byte strings that also start earlier in the corpus.

Only equality of the first LENGTH bytes of suffixes matters, so a cover of the
positions is sampled: in every window of LENGTH bytes the k-gram with the smallest
hash. Equal windows hold the same sampled k-gram at the same offset. Sampled
suffixes are sorted by name, names that occur once are dropped, and around the
others all remaining suffixes are merged by comparing their LENGTH-byte prefixes
with those before them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierflow.llm.words import _ODD, as_bytes, mix, powers

LENGTH = 100
GRAM = 24
BLOCK = 1 << 19  # bytes hashed at once


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """One number per substring of ``width`` bytes."""
    out = []
    for at in range(0, len(data) - width + 1, BLOCK):
        block = data[at : at + BLOCK + width - 1]
        up, down = powers(max(len(block), BLOCK + LENGTH))
        total = np.zeros(len(block) + 1, np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up[: len(block)], out=total[1:])
        out.append(mix((total[width:] - total[:-width]) * down[: len(block) - width + 1] * _ODD[2]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sampled(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names and places of the sampled k-grams, and the first and last window that each stands for."""
    names = rolling(data, GRAM)
    windows = len(data) - LENGTH + 1
    if windows <= 0:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty
    owners = []
    reach = LENGTH - GRAM + 1
    for at in range(0, windows, BLOCK):
        part = names[at : at + min(BLOCK, windows - at) + reach - 1]
        best = np.arange(len(part))
        width = 1
        while width < reach:  # smallest of twice as many, the leftmost in a tie
            step = min(width, reach - width)
            a, b = best[: len(best) - step], best[step:]
            best = np.where(part[b] < part[a], b, a)
            width += step
        owners.append(best + at)
    owner = np.concatenate(owners)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    last = np.append(first[1:], windows) - 1
    places = owner[first]
    return names[places], places, first, last


def _named(docs: DataFrame) -> DataFrame:
    def scan(batches):
        for batch in batches:
            ids, names, places = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                name, place, _, _ = sampled(as_bytes(text.as_py()))
                ids.append(np.full(len(name), doc_id, np.int64))
                names.append(name.view(np.int64))
                places.append(place.astype(np.int32))
            arrays = [pa.array(np.concatenate(x) if x else np.zeros(0, k), k) for x, k in ((names, "int64"), (ids, "int64"), (places, "int32"))]
            whole = pa.RecordBatch.from_arrays(arrays, ["name", "doc_id", "place"])
            for at in range(0, whole.num_rows, 20_000):
                yield whole.slice(at, 20_000)

    return docs.mapInArrow(scan, "name bigint, doc_id bigint, place int")


def _stored(docs: DataFrame) -> DataFrame:
    """doc_id and the compressed bytes of each text.

    Both joins with texts are on doc_id and take these same rows, so the texts
    move between tasks once, and small.
    """

    def pack(batches):
        packer = zstandard.ZstdCompressor()
        for batch in batches:
            packed = [packer.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "packed"])

    # no nulls: the joins then add no filter, and their exchange of the texts is one and the same
    return docs.mapInArrow(pack, "doc_id bigint not null, packed binary not null")


def _surroundings(docs_places: DataFrame) -> DataFrame:
    """Per repeated name and place: the bytes of all windows it stands for."""

    def cut(batches):
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc_id, packed, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                raw = unpacker.decompress(packed.as_py())
                name, place, first, last = sampled(np.frombuffer(raw, np.uint8))
                for i in np.flatnonzero(np.isin(place, places.values.to_numpy())).tolist():
                    rows.append((int(name[i].view(np.int64)), doc_id, int(first[i]), raw[first[i] : last[i] + LENGTH]))
                    if len(rows) >= 10_000:
                        yield _rows(rows)
                        rows = []
            if rows:
                yield _rows(rows)

    def _rows(rows):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["name", "doc_id", "first", "bytes"])

    return docs_places.mapInArrow(cut, "name bigint, doc_id bigint, first int, bytes binary")


def _windows(batch: pa.RecordBatch):
    """Of all windows in a batch: row, start in its document, and number of the content."""
    lengths = np.diff(np.frombuffer(batch.column(3).buffers()[1], np.int32, len(batch) + 1, batch.column(3).offset * 4))
    data = np.concatenate([np.frombuffer(b, np.uint8) for b in batch.column(3).to_pylist()])
    ends = np.cumsum(lengths)
    number = lengths - LENGTH + 1
    row = np.repeat(np.arange(len(batch)), number)
    inner = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    content = rolling(data, LENGTH)[(ends - lengths)[row] + inner]
    return row, batch.column(2).to_numpy()[row] + inner, content


def _repeats(surroundings: DataFrame) -> DataFrame:
    """(doc_id, start, end) of runs of windows that start earlier too, from rows sorted by name and place."""

    def compare(batches):
        carried_name, seen, seen_doc, seen_start = None, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            names, docs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            row, start, content = _windows(batch)
            doc = docs[row]
            # windows of the name that the batches before ended with go on
            if carried_name != names[0]:
                seen, seen_doc, seen_start = seen[:0], seen_doc[:0], seen_start[:0]
            every = np.concatenate([seen, content])
            every_doc, every_start = np.concatenate([seen_doc, doc]), np.concatenate([seen_start, start])
            _, first, which = np.unique(every, return_index=True, return_inverse=True)
            source = first[which[len(seen) :]]
            again = (every_doc[source] != doc) | (every_start[source] != start)
            # runs end with their row as well
            hit = np.flatnonzero(again)
            if len(hit):
                new = np.concatenate(([True], (np.diff(hit) > 1) | (np.diff(row[hit]) > 0)))
                begin = hit[new]
                stop = hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[begin]), pa.array(start[begin], pa.int64()), pa.array(start[stop] + LENGTH, pa.int64())], ["doc_id", "start", "end"]
                )
            carried_name = names[-1]
            own = np.concatenate([np.ones(len(seen), bool) if names[0] == carried_name else np.zeros(len(seen), bool), names[row] == carried_name])
            kept = first[own[first]]
            seen, seen_doc, seen_start = every[kept], every_doc[kept], every_start[kept]

    sorted_rows = surroundings.repartition("name").sortWithinPartitions("name", "doc_id", "first")
    return sorted_rows.mapInArrow(compare, "doc_id bigint, start bigint, end bigint")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row of ``docs``.

    A byte goes if a LENGTH-byte string that covers it also starts earlier: in a
    smaller doc_id, or before in the same document. Strings are judged on the
    input and never cross documents. Null texts are empty. Rows with a null
    doc_id have no place in the order: nothing is removed from them, and they
    make nothing go elsewhere. Rows that repeat a doc_id do not precede each
    other at equal starts. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    placed = rows.where("doc_id is not null")
    stored = _stored(placed)
    named = _named(placed)
    repeated = named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    places = named.join(repeated, "name", "left_semi").groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    runs = _repeats(_surroundings(stored.join(places, "doc_id").select("doc_id", "packed", "places")))
    per_doc = runs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))

    def finish(batches):
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc_id, packed, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                raw = unpacker.decompress(packed.as_py())
                kept, at, spans, end = [], 0, 0, -1
                for run in runs or []:
                    if run["start"] > end:
                        spans += 1
                    if run["start"] > at:
                        kept.append(raw[at : run["start"]])
                    end = max(end, run["end"])
                    at = max(at, run["end"])
                rest = b"".join([*kept, raw[at:]])
                out.append((doc_id, len(raw), len(raw) - len(rest), spans, hashlib.sha256(rest).hexdigest(), rest))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    judged = stored.join(per_doc, "doc_id", "left").select("doc_id", "packed", "runs")
    unplaced = _stored(rows.where("doc_id is null").select(F.lit(0).cast("bigint"), "text"))
    unplaced = unplaced.select(F.lit(None).cast("bigint").alias("doc_id"), "packed", F.lit(None).cast(per_doc.schema["runs"].dataType).alias("runs"))
    return judged.unionByName(unplaced).mapInArrow(finish, schema)
