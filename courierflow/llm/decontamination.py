"""Benchmark decontamination: words of documents inside n-word windows of test items.

Test items and documents are normalised alike: A-Z become small, and a word is a
run of digits, letters a-z and characters beyond ASCII. The distinct windows of
the items form a hash set, which every task looks the windows of its documents up
in, and each hit is compared word by word. The set is broadcast while its size, known before, is
within BROADCAST_BYTES. A larger benchmark is broadcast as a bit map of fixed
size only; what passes it is compared with the items by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courierflow.llm import words as W
from courierflow.llm.sketch import bucket_counts
from courierflow.session import written

WINDOW = 10
BROADCAST_BYTES = 64 << 20  # of the set: windows with the ids of their items
MAP_BITS = 24  # bits of the map that stands for a larger set: 2**24, or 2 MB
IN_WORD = np.ones(256, bool)
IN_WORD[:0x30] = IN_WORD[0x3A:0x61] = IN_WORD[0x7B:0x80] = False
BLOCK = 1 << 20


class Words:
    """The words of a text: where they are in its UTF-8 bytes, and a number for each."""

    def __init__(self, text: str | None):
        self.low = W.LOWER[W.as_bytes(text)]
        starts, ends, hashes = [], [], []
        for a, b in _blocks(self.low):
            data = self.low[a:b]
            solid = np.zeros(len(data) + 2, np.int8)
            solid[1:-1] = IN_WORD[data]
            edges = np.flatnonzero(np.diff(solid))
            first, last = edges[::2], edges[1::2]
            up, down = W.powers(max(len(data), BLOCK) + 1)
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
            hashes.append(W.mix((total[last] - total[first]) * down[first]))
            starts.append(first + a)
            ends.append(last + a)
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self._hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self._totals: np.ndarray | None = None
        self._raw: bytes | None = None

    def __len__(self) -> int:
        return len(self.starts)

    def windows(self, n: int) -> np.ndarray:
        """One number for each n consecutive words, from prefix sums."""
        count = len(self) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint64)
        up, down = W.powers(max(len(self), BLOCK) + 1)
        if self._totals is None:
            self._totals = np.zeros(len(self) + 1, np.uint64)
            np.cumsum(self._hashes * up[: len(self)], out=self._totals[1:])
        return W.mix((self._totals[n:] - self._totals[:count]) * down[:count] + np.uint64(n))

    def text(self, first: int, n: int) -> str:
        """n words from ``first``, as they are compared: in small letters, one space apart."""
        if self._raw is None:
            self._raw = self.low.tobytes()
        pairs = zip(self.starts[first : first + n].tolist(), self.ends[first : first + n].tolist())
        return b" ".join([self._raw[a:b] for a, b in pairs]).decode("utf-8", "surrogatepass")


def _blocks(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of blocks that no word crosses; a longer word is a longer block."""
    start = 0
    while start < len(data):
        stop = min(start + BLOCK, len(data))
        while stop < len(data):
            gaps = np.flatnonzero(~IN_WORD[data[start:stop]])
            if len(gaps):
                stop = start + int(gaps[-1]) + 1
                break
            stop = min(stop + BLOCK, len(data))
        yield start, stop
        start = stop


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id string, gram, hash, n): the distinct windows of the items, n words each."""
    schema = "item_id string, gram string, hash bigint, n int"

    def cut(batches):
        for batch in batches:
            rows: set[tuple] = set()
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                found = Words(text)
                n = min(window, len(found))
                if n:
                    for at, h in enumerate(found.windows(n).view(np.int64).tolist()):
                        rows.add((item or "", found.text(at, n), h, n))
            yield from pa.Table.from_pylist(
                [dict(zip(("item_id", "gram", "hash", "n"), r)) for r in rows],
                pa.schema([("item_id", pa.string()), ("gram", pa.string()), ("hash", pa.int64()), ("n", pa.int32())]),
            ).to_batches()

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(cut, schema).distinct()


class _Lookup:
    """Which numbers of windows are in the set, by word count: a bit map first, then the sorted numbers if they are known."""

    def __init__(self, bits: int, lengths: list[int], marked: np.ndarray, hashes: np.ndarray | None):
        self.shift, self.lengths, self.marked, self.hashes = np.uint64(64 - bits), lengths, marked, hashes

    def hits(self, found: Words) -> list[tuple[int, np.ndarray]]:
        """(n, places) of the windows of n words that are in the set."""
        out = []
        for n in self.lengths:
            numbers = found.windows(n)
            at = np.flatnonzero(self.marked[numbers >> self.shift])
            if self.hashes is not None and len(at):
                near = np.minimum(np.searchsorted(self.hashes, numbers[at]), len(self.hashes) - 1)
                at = at[self.hashes[near] == numbers[at]]
            if len(at):
                out.append((n, at))
        return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words joined where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


HITS = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
HITS_ARROW = [
    ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("items", pa.list_(pa.string())),
]


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``row``, all columns of ``docs``, plus n_words, spans and items for every row.

    spans are the maximal stretches of hit words (word numbers, end exclusive) and
    items the sorted ids of the items with a window in the text. An item shorter
    than ``window`` is one window as a whole. Null texts and texts without a word
    have no hits, and items without a word no window; an item without id counts as the item
    named by the empty text, and items that share an id as one. Repeated rows are judged each for itself. An
    empty benchmark hits nothing, an empty table of documents gives no rows, and
    other columns are kept within ``row``, so no name can clash.
    """
    windows = written(item_windows(benchmark, window), "windows")
    size, lengths = windows.agg(
        F.sum(F.octet_length("gram") + F.octet_length("item_id") + 100), F.sort_array(F.collect_set("n"))
    ).first()
    rows = docs.select(F.struct("*").alias("row"))
    if (size or 0) <= broadcast_bytes:
        return _by_set(rows, windows, lengths)
    return _by_join(rows, windows, lengths)


def _by_set(rows: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Hits found and compared in the task that reads a document; the whole set, its size checked, is broadcast."""
    grams: dict[str, list[str]] = {}
    numbers: set[int] = set()
    for h, gram, item in windows.select("hash", "gram", "item_id").toLocalIterator():
        grams.setdefault(gram, []).append(item)
        numbers.add(h)
    hashes = np.sort(np.fromiter(numbers, np.int64, len(numbers)).view(np.uint64))
    bits = max(12, (16 * len(hashes)).bit_length())
    marked = np.zeros(1 << bits, bool)
    marked[hashes >> np.uint64(64 - bits)] = True
    held = rows.sparkSession.sparkContext.broadcast((_Lookup(bits, lengths, marked, hashes), grams))

    def judge(text):
        lookup, known = held.value
        found = Words(text)
        spans, items = [], set()
        for n, places in lookup.hits(found):
            for at in places.tolist():
                of = known.get(found.text(at, n))
                if of is not None:
                    spans.append((at, at + n))
                    items.update(of)
        return len(found), [{"start": a, "end": b} for a, b in _merged(spans)], sorted(items)

    def scan(batches):
        for batch in batches:
            judged = [judge(t) for t in batch.column("row").field("text").to_pylist()]
            columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*judged), HITS_ARROW)] if judged else [
                pa.array([], kind) for _, kind in HITS_ARROW
            ]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", *(n for n, _ in HITS_ARROW)])

    return rows.mapInArrow(scan, _with_row(rows))


def _with_row(rows: DataFrame) -> T.StructType:
    hits = T.StructType.fromDDL(HITS)
    return T.StructType([rows.schema["row"], *hits.fields])


def _by_join(rows: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Hits of a benchmark of any size: candidates pass a bit map and are joined with the windows on their text.

    A document is known by a digest of its text, so equal texts are joined once.
    """
    counts = bucket_counts(windows.select("hash"), lambda b: iter([b.column(0).to_numpy().view(np.uint64)]), MAP_BITS)
    held = rows.sparkSession.sparkContext.broadcast(_Lookup(MAP_BITS, lengths, counts > 0, None))
    names = [("key", pa.binary()), ("n_words", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("gram", pa.string())]

    def scan(batches):
        for batch in batches:
            out = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                found = Words(text)
                out.append((key, len(found), None, None, None))
                for n, places in held.value.hits(found):
                    out += [(key, len(found), at, n, found.text(at, n)) for at in places.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], kind) for i, (_, kind) in enumerate(names)], [c for c, _ in names]
            )

    text = F.coalesce("row.text", F.lit(""))
    keyed = rows.withColumn("key", F.unhex(F.sha2(text, 256)))
    texts = keyed.select("key", text.alias("text"))
    found = written(texts.mapInArrow(scan, "key binary, n_words bigint, at bigint, n int, gram string").distinct(), "candidates")
    known = found.where("gram is not null").join(windows.select("gram", "item_id"), "gram")
    grouped = known.groupBy("key").agg(
        F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("until"))).alias("hits"),
        F.sort_array(F.collect_set("item_id")).alias("items"),
    )
    nothing = F.struct(F.lit(-1).cast("bigint").alias("start"), F.lit(-1).cast("bigint").alias("end"))
    # windows in order; each either lengthens the last stretch or begins one
    step = lambda done, hit: F.when(
        hit["at"] <= done["last"]["end"],
        F.struct(done["out"].alias("out"), F.struct(done["last"]["start"].alias("start"), F.greatest(done["last"]["end"], hit["until"]).alias("end")).alias("last")),
    ).otherwise(
        F.struct(F.concat(done["out"], F.array(done["last"])).alias("out"), F.struct(hit["at"].alias("start"), hit["until"].alias("end")).alias("last"))
    )
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    folded = F.aggregate(
        F.array_sort("hits"), F.struct(empty.alias("out"), nothing.alias("last")), step,
        lambda done: F.filter(F.concat(done["out"], F.array(done["last"])), lambda s: s["start"] >= 0),
    )
    judged = found.where("gram is null").select("key", "n_words").join(grouped.withColumn("spans", folded).drop("hits"), "key", "left")
    out = keyed.join(judged, "key", "left")
    return out.select(
        "row", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("spans", empty).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def digests(hits: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of the rows of ``find_hits``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return hits.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, most_hit: float = 1.0, **options) -> DataFrame:
    """``docs`` without what the benchmark contains.

    Documents of whose words more than the share ``most_hit`` is hit go (0.0: all that are hit);
    in the others each stretch of hit words gives way to one space, and n_chars, if there
    is such a column, follows the text. Null texts and texts without hits stay as they are.
    """
    hits = find_hits(docs, benchmark, **options)
    names = docs.columns
    schema = docs.schema
    kept = hits.where(F.aggregate("spans", F.lit(0.0), lambda n, s: n + s["end"] - s["start"]) <= F.col("n_words") * F.lit(float(most_hit)))

    def cut(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("row").field("text").to_pylist(), batch.column("spans").to_pylist()):
                if spans:
                    found, raw, at, parts = Words(text), text.encode("utf-8", "surrogatepass"), 0, []
                    for s in spans:
                        parts.append(raw[at : int(found.starts[s["start"]])])
                        at = int(found.ends[s["end"] - 1])
                    text = b" ".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    rows = kept.select("row", "spans")
    out = rows.mapInArrow(cut, T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]))
    return out.select(
        *[
            F.col("text") if c == "text"
            else F.when(F.col("text") == F.col("row.text"), F.col("row.n_chars")).otherwise(F.length("text").cast(schema[c].dataType)).alias(c)
            if c == "n_chars" else F.col("row").getField(c).alias(c)
            for c in names
        ]
    )


