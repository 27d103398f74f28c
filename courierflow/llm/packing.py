"""Packing of tokenized documents into sequences of one length by bin completion.

Documents matter to the packing only by their length, and there are at most
``capacity`` lengths. So Spark counts the pieces of each length, the search runs
over these counts, and its plan (fillings, each with the number of sequences
that use it) is applied to all pieces by their rank within their length.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courierflow.session import written

CAPACITY = 4096
END_ID = 1
HELD_WORDS = 300_000  # words whose ids a Python worker keeps
STEPS = 400_000  # lengths looked at by the search, after which the best plan so far is used
HELD_CHOICES = 64  # nodes of the search that hold their place among the fillings
PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

Filling = tuple[int, ...]  # lengths in one sequence, largest first
Plan = list[tuple[Filling, int]]


# Words of these letters and ASCII signs after them need no general normalization:
# lower case is letter by letter, and the letters and the signs are tokenized apart.
SIMPLE_WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return dict(zip(plain, plain)) | {b: 256 + n for n, b in enumerate(rest)}


class WordIds:
    """Token ids of texts, looked up word by word.

    The tokenizer never joins characters across white space, so a text has the
    ids of its words in turn. Two generations of words are held: when the newer
    is full it becomes the older, so frequent words stay and memory is bounded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def part(self, text: str) -> bytes:
        spelled = text.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(spelled)], np.uint32).tobytes()

    def word(self, word: str) -> bytes:
        if simple := SIMPLE_WORD.fullmatch(word):
            name, signs = simple.groups()
            return self.part(name.lower()) + (self.part(signs) if signs else b"")
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()

    def look_up(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.word(word)
        if len(word) <= 100:
            if len(self.newer) >= HELD_WORDS:
                self.older, self.newer = self.newer, {}
            self.newer[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the text."""
        out = []
        for word in text.replace("\n", " ").split(" "):
            ids = self.newer.get(word)
            out.append(self.look_up(word) if ids is None else ids)
        return b"".join(out)


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Ids of each text, then ``end_id``, cut into pieces of at most ``capacity``."""
    end = np.uint32(end_id).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer_path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of.encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, PIECE_SCHEMA)


# ---- the search over lengths


class Budget:
    """Steps that a search may still take; a step looks at one length."""

    def __init__(self, steps: int):
        self.left = steps

    def spend(self, steps: int = 1) -> bool:
        self.left -= steps
        return self.left >= 0


def fillings(room: int, counts: dict[int, int], most_waste: int, budget: Budget) -> Iterator[Filling]:
    """Every undominated way to fill ``room`` with at most ``most_waste`` left, least waste first, large lengths first.

    They come one by one, each asked for when the search returns for it. Sums that
    the lengths cannot make are never tried: the sums within reach of the smallest
    lengths are held as bits. A filling is left out if a piece would still fit, or
    if a larger unused length could stand in for one of its members, or for two of
    them together: what that frees packs at least as well.
    """
    sizes = sorted(s for s, n in counts.items() if n and s <= room)
    if not budget.spend(len(sizes) + 1):
        return
    reach = [1]  # bit t: the lengths before this one can sum to t
    inside = (1 << (room + 1)) - 1
    for size in sizes:
        bits, more, step = reach[-1], min(counts[size], room // size), 1
        while more:
            step = min(step, more)
            bits |= (bits << (step * size)) & inside
            more -= step
            step *= 2
        reach.append(bits)

    def exact(target: int, i: int) -> Iterator[Filling]:
        if not target:
            yield ()
            return
        i = bisect_right(sizes, target, 0, i)
        while i and reach[i] >> target & 1 and budget.spend():
            size = sizes[i - 1]
            for k in range(min(counts[size], target // size), 0, -1):
                if reach[i - 1] >> (target - k * size) & 1:
                    for rest in exact(target - k * size, i - 1):
                        yield (size,) * k + rest
            i -= 1

    for waste in range(min(room, most_waste) + 1):
        if reach[-1] >> (room - waste) & 1:
            for filling in exact(room - waste, len(sizes)):
                if not budget.spend():
                    return
                if not _dominated(filling, waste, counts, sizes):
                    yield filling


def _dominated(filling: Filling, waste: int, counts: dict[int, int], sizes: list[int]) -> bool:
    used = Counter(filling)

    def free(low: int, high: int) -> bool:
        i = bisect_left(sizes, low)
        while i < len(sizes) and sizes[i] <= high:
            if counts[sizes[i]] > used[sizes[i]]:
                return True
            i += 1
        return False

    if free(1, waste) or any(free(size + 1, size + waste) for size in used):
        return True
    pairs = {a + b for a, b in combinations(used, 2)} | {2 * a for a, k in used.items() if k > 1}
    return any(free(pair, pair + waste) for pair in pairs)


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing: each piece, largest first, goes where it leaves the least room.

    Sequences with the same filling are one entry, so the work grows with the
    number of lengths. A sequence that has the least room for a length still has
    it after taking one, so it takes as many as it can hold.
    """
    plan: Counter[Filling] = Counter()
    opened: dict[int, Counter[Filling]] = {}  # room left, then filling: sequences
    rooms: list[int] = []

    def put(room: int, filling: Filling, times: int) -> None:
        plan[filling] += times
        if room:
            if room not in opened:
                opened[room] = Counter()
                insort(rooms, room)
            opened[room][filling] += times

    def take(room: int, filling: Filling, times: int) -> None:
        for held in (plan, opened[room]):
            held[filling] -= times
            if not held[filling]:
                del held[filling]
        if not opened[room]:
            del opened[room]
            rooms.pop(bisect_left(rooms, room))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            i = bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                filling, times = next(iter(opened[room].items()))
            else:
                room, filling, times = capacity, (), left
            fit = min(room // size, left)
            times = min(times, left // fit)
            if filling:
                take(room, filling, times)
            put(room - fit * size, filling + (size,) * fit, times)
            left -= fit * times
    return list(plan.items())


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """No plan has fewer sequences than this (the bound of Martello and Toth).

    For each k up to half a sequence: lengths above ``capacity - k`` share with
    none from k on, the others above half share with none of each other, and the
    lengths from k to half fill the room that these leave, then new sequences.
    """
    number = np.zeros(capacity + 2, np.int64)
    for size, n in counts.items():
        number[size] = n
    upto, mass = np.cumsum(number), np.cumsum(number * np.arange(capacity + 2))
    half = capacity // 2
    k = np.arange(1, half + 1)
    large = upto[capacity] - upto[half]
    shared = upto[capacity - k] - upto[half]
    room = shared * capacity - (mass[capacity - k] - mass[half])
    small = mass[half] - mass[k - 1]
    more = -((room - small) // capacity)  # rounded up
    return int(max(large + np.maximum(more, 0).max(initial=0), -(-mass[capacity] // capacity)))


def sequences(plan: Plan) -> int:
    return sum(times for _, times in plan)


class _Node:
    """Counts left at a point of the search, and the choices that were not yet tried there."""

    def __init__(self, left: dict[int, int], plan: Plan, used: int):
        self.left, self.plan, self.used = left, plan, used
        self.spare: int | None = None  # waste that still beat the incumbent when the node was first asked
        self.tried = 0
        self.choices: Iterator[tuple[Filling, int]] | None = None


def search_plan(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> tuple[Plan, int, bool]:
    """The plan, a number of sequences that no plan can go below, and whether the search ended.

    Bin completion: the largest length left is completed by every undominated
    filling in turn, as often as the counts allow at once, then once. A branch ends
    when the waste it has spent, or the bound of what is left, leaves no way to
    beat the incumbent, or when the same counts were reached before with as few
    sequences. At each node the rest is packed best-fit, and becomes the incumbent
    if it is better. The search ends at once when the incumbent meets the bound,
    and after ``steps`` with the best plan found; the plan always holds all pieces.
    """
    counts = {s: n for s, n in counts.items() if n}
    best = best_fit(counts, capacity)
    if not counts:
        return best, 0, True
    bound = least_sequences(counts, capacity)
    budget = Budget(steps)

    def choices(node: _Node) -> Iterator[tuple[Filling, int]]:
        top = max(node.left)
        rest = dict(node.left)
        rest[top] -= 1
        if node.spare is None:
            held = sum(s * n for s, n in node.left.items())
            node.spare = (sequences(best) - 1 - node.used) * capacity - held
        for way in fillings(capacity - top, rest, node.spare, budget):
            filling = (top, *way)
            times = min(node.left[s] // k for s, k in Counter(filling).items())
            if lost := capacity - sum(filling):
                times = min(times, node.spare // lost)
            yield from ((filling, t) for t in sorted({times, 1}, reverse=True) if 0 < t <= times)

    seen: dict[bytes, int] = {}
    stack = [_Node(counts, [], 0)]
    while stack and budget.left > 0 and sequences(best) > bound:
        node = stack[-1]
        if node.choices is None:  # choices of nodes far up are dropped, and found again
            node.choices = islice(choices(node), node.tried, None)
        choice = next(node.choices, None)
        if choice is None:
            stack.pop()
            continue
        node.tried += 1
        filling, times = choice
        after = dict(node.left)
        for s, k in Counter(filling).items():
            after[s] -= times * k
            if not after[s]:
                del after[s]
        used, plan = node.used + times, [*node.plan, choice]
        budget.spend(len(after) + 1)
        if not after:
            if used < sequences(best):
                best = plan
            continue
        if used + least_sequences(after, capacity) >= sequences(best):
            continue
        key = hashlib.blake2b(np.array(sorted(after.items()), np.int64).tobytes(), digest_size=16).digest()
        if seen.get(key, used + 1) <= used:
            continue
        seen[key] = used
        tail = best_fit(after, capacity)
        if used + sequences(tail) < sequences(best):
            best = plan + tail
        stack.append(_Node(after, plan, used))
        if len(stack) > HELD_CHOICES:
            stack[-HELD_CHOICES - 1].choices = None
    return best, bound, sequences(best) == bound or budget.left > 0


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> Plan:
    """The plan of ``search_plan``: a filling of lengths and the number of sequences that use it, entry by entry."""
    return search_plan(counts, capacity, steps)[0]


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a length of 1 to ``capacity``) plus sequence_id and offset, gapless from 0.

    The plan has at most a few entries per length, whatever the number of pieces,
    and is what tasks get. Ranks within a length are exact: pieces are dealt to
    hash buckets, so that no length is ever in one task, and the buckets' counts
    are added up.
    """
    spark = pieces.sparkSession
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    per = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = spark.sparkContext.broadcast(_slots(pack_counts(counts, capacity), counts))

    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        keyed.withColumn("row", F.row_number().over(order) - 1)
        .join(per.select("length", "bucket", "before"), ["length", "bucket"])
        .withColumn("rank", F.col("row") + F.col("before"))
        .drop("row", "before", "bucket")
    )
    names = [c for c in ranked.columns if c != "rank"]
    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "rank") + ", sequence_id bigint, offset bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, starts, base, per_sequence, at = held.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            line = first[length] + batch.column("rank").to_numpy()
            slot = np.searchsorted(starts, line, side="right") - 1
            turn = line - starts[slot]
            arrays = [batch.column(c) for c in names]
            arrays.append(pa.array(base[slot] + turn // per_sequence[slot], pa.int64()))
            arrays.append(pa.array(at[slot] + (turn % per_sequence[slot]) * length, pa.int64()))
            yield pa.RecordBatch.from_arrays(arrays, [*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(place, schema)


def _slots(plan: Plan, counts: dict[int, int]) -> tuple[np.ndarray, ...]:
    """The plan as stretches of one line on which all pieces stand, by length and rank."""
    first = np.zeros(max(counts, default=0) + 1, np.int64)
    total = 0
    for size in sorted(counts):
        first[size] = total
        total += counts[size]
    taken = dict.fromkeys(counts, 0)
    rows = []
    base = 0
    for filling, times in plan:
        at = 0
        for size in sorted(set(filling), reverse=True):
            k = filling.count(size)
            rows.append((first[size] + taken[size], base, k, at))
            taken[size] += k * times
            at += k * size
        base += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return first, *columns


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its place in a sequence.

    A null or empty text is the end id alone. Only documents longer than
    ``capacity`` are cut. Repeated rows and null ids are packed like others, each
    row for itself; an empty table gives no rows; other columns are ignored.
    """
    return pack_pieces(written(token_pieces(docs, tokenizer_path, capacity), "pieces"), capacity)
