"""Runs: stretches of words that repeat with a period, all of them, in every text.

A run is a stretch whose words equal those one period later, as long as it can be,
of at least two periods. Whether a run of period p passes a place is found on the
harmonic grid 0, p, 2p, ...: two neighbouring grid places lie in every run of that
period, and how far the words agree after and before them (longest common
extensions, LCE) gives its ends. Over all periods the grids have n ln n places.

An LCE compares words directly until both places have come to sampled positions.
Those are taken from a difference cover modulo V: any two positions come to a
pair of samples after the same number, at most V - 1, of words. From there the
answer is a minimum over the common prefixes of neighbours in the order of the sampled
suffixes, read off a sparse table. Most grid places part within the first words, so
suffixes are sorted only for texts in which some do not.

The work is done by numpy for many texts at a time, set apart by words that occur once.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A perfect difference set: each number from 1 to 30 is the difference of one pair, modulo 31.
COVER = (0, 1, 3, 8, 12, 18)
V = 31
SHORTEST = 12
BATCH_WORDS = 1 << 18  # words worked on at once; a longer text alone
PAIRS = 1 << 17  # grid places worked on at once


def _waits() -> np.ndarray:
    """waits[i, d]: words until positions i and i + d (modulo V) are both samples."""
    samples = set(COVER)
    return np.array(
        [[next(t for t in range(V) if (i + t) % V in samples and (i + d + t) % V in samples) for d in range(V)] for i in range(V)],
        np.int32,
    )


WAITS = _waits()


class SampledSuffixes:
    """LCE between sampled positions of ``row``, whose last word occurs once."""

    def __init__(self, row: np.ndarray):
        n = len(row)
        self.row = np.concatenate([row, np.zeros(2 * V, row.dtype)])
        starts = np.arange(0, n, V)
        at = (starts[:, None] + np.array(COVER)).ravel()
        at = at[at < n]
        count = len(at)
        self.index = np.full(n + V, -1, np.int64)
        self.index[at] = np.arange(count)
        # names of the first V words, in their order; then of 2V, 4V, ... words
        keys = np.ascontiguousarray(self.row[at[:, None] + np.arange(V)].astype(">u4")).view(f"S{4 * V}").ravel()
        names = [_named(keys)]
        reach = V
        while names[-1].max(initial=0) < count - 1 and reach < n:
            later = np.minimum(at + reach, n + V - 1)
            step = self.index[later]
            second = np.where(step >= 0, names[-1][step] + 1, 0)
            names.append(_named(names[-1].astype(np.int64) * (count + 1) + second))
            reach *= 2
        self.rank = names[-1]
        order = np.argsort(self.rank, kind="stable")
        self.table = _sparse_table(self._neighbours(at[order], names))

    def _neighbours(self, at: np.ndarray, names: list[np.ndarray]) -> np.ndarray:
        """Common words of each sampled suffix, in order, with the one before it."""
        if len(at) < 2:
            return np.zeros(len(at), np.int32)
        a, b = at[:-1].copy(), at[1:].copy()
        n = len(self.index) - V
        for k in range(len(names) - 1, -1, -1):
            i, j = self.index[np.minimum(a, n)], self.index[np.minimum(b, n)]
            same = (i >= 0) & (j >= 0) & (names[k][i] == names[k][j])
            a[same] += V << k
            b[same] += V << k
        alive = np.arange(len(a))
        for _ in range(V):
            alive = alive[self.row[a[alive]] == self.row[b[alive]]]
            if not len(alive):
                break
            a[alive] += 1
            b[alive] += 1
        return np.concatenate([[0], a - at[:-1]]).astype(np.int32)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from the sampled positions a and b on, a != b."""
        x, y = self.rank[self.index[a]], self.rank[self.index[b]]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.log2(high - low).astype(np.int64)
        return np.minimum(self.table[level, low], self.table[level, high - (1 << level)]).astype(np.int64)


def _named(keys: np.ndarray) -> np.ndarray:
    """The place of each key among the distinct ones."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), np.int64)
    new[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _sparse_table(low: np.ndarray) -> np.ndarray:
    """table[k, i]: the minimum of low[i : i + 2**k]."""
    rows = [low]
    while (half := 1 << (len(rows) - 1)) * 2 <= len(low):
        last = rows[-1]
        rows.append(np.concatenate([np.minimum(last[:-half], last[half:]), last[-half:]]))
    return np.stack(rows)


def _directly(row: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the padded ``row`` that agree from i and j on before both come to samples, and which pairs have come there."""
    wait = WAITS[i % V, (j - i) % V]
    common = np.zeros(len(i), np.int64)
    arrived = np.zeros(len(i), bool)
    alive = np.arange(len(i))
    for t in range(V):
        here = wait[alive] == t
        arrived[alive[here]] = True
        alive = alive[~here]
        alive = alive[row[i[alive] + t] == row[j[alive] + t]]
        if not len(alive):
            break
        common[alive] += 1
    return common, arrived


class Extensions:
    """LCE of any two positions of ``row``, whose last word occurs once."""

    def __init__(self, row: np.ndarray):
        self.suffixes = SampledSuffixes(row)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        common, arrived = _directly(self.suffixes.row, i, j)
        far = np.flatnonzero(arrived)
        if len(far):
            common[far] += self.suffixes.common(i[far] + common[far], j[far] + common[far])
        return common


class Batch:
    """The runs of several texts, given as one row of word numbers from 1 up.

    ``sizes`` are the words of each text; a word that occurs once stands behind each.
    """

    def __init__(self, row: np.ndarray, sizes: np.ndarray, shortest: int):
        self.row, self.sizes, self.shortest = row, sizes, shortest
        self.begins = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.found: list[np.ndarray] = []
        self.open: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self.built: tuple[bytes, Extensions, Extensions, np.ndarray] | None = None

    def runs(self) -> np.ndarray:
        """(start, end, period) of every run, by start, then period; positions are those of the row."""
        ahead = np.concatenate([self.row, np.zeros(2 * V, self.row.dtype)])
        back = np.concatenate([self.row[::-1], np.zeros(2 * V, self.row.dtype)])
        for i, p in self._grid():
            i, p = _where(ahead[i] == ahead[i + p], i, p)
            if not len(i):
                continue
            after, far = _directly(ahead, i, i + p)
            n = len(self.row)
            before, far_back = _directly(back, n - i - p, n - i)
            self._keep(i, p, before, after, ~(far | far_back))
            i, p = _where(far | far_back, i, p)
            self.open.append((i, p))
            self.waiting += len(i)
            if self.waiting > 1 << 20:
                self._resolve()
        self._resolve()
        return _smallest_periods(self.found)

    def _grid(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, period): the places 0, p, 2p, ... of each text, for periods up to half of it."""
        halves = np.where(self.sizes >= self.shortest, self.sizes // 2, 0)
        text = np.repeat(np.arange(len(halves)), halves)
        period = np.arange(len(text)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
        begin = self.begins[text]
        counts = (self.sizes[text] - 1) // period
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        for low in range(0, total, PAIRS):
            high = min(low + PAIRS, total)
            a, b = np.searchsorted(ends, [low, high - 1], side="right")
            part = slice(a, b + 1)
            first = ends[part] - counts[part]
            n = np.minimum(ends[part], high) - np.maximum(first, low)
            p = np.repeat(period[part], n)
            k = np.arange(low, high) - np.repeat(first, n)
            yield np.repeat(begin[part], n) + k * p, p

    def _keep(self, i, p, before, after, known) -> None:
        long = known & (before + after + p >= np.maximum(self.shortest, 2 * p))
        i, p, before, after = _where(long, i, p, before, after)
        if len(i):
            self.found.append(np.unique(np.stack([i - before, i + p + after, p]), axis=1))

    def _resolve(self) -> None:
        """Full extensions of the open places, in the texts that have some."""
        if not self.waiting:
            return
        i, p = (np.concatenate(c) for c in zip(*self.open))
        self.open, self.waiting = [], 0
        text = np.searchsorted(self.begins, i, side="right") - 1
        texts = np.unique(text)
        if self.built is None or self.built[0] != texts.tobytes():
            row = np.concatenate([self.row[self.begins[t] : self.begins[t + 1]] for t in texts])
            # the reversed row ends in a word of its own, too
            shift = np.zeros(len(self.sizes), np.int64)
            shift[texts] = np.cumsum(self.sizes[texts] + 1) - self.sizes[texts] - 1 - self.begins[texts]
            last = self.row.max() + 1
            self.built = (texts.tobytes(), Extensions(row), Extensions(np.append(row[::-1], last)), shift)
        _, ahead, back, shift = self.built
        n = len(back.suffixes.index) - V - 1
        for low in range(0, len(i), PAIRS):
            part = slice(low, low + PAIRS)
            at, q = i[part] + shift[text[part]], p[part]
            after = ahead.common(at, at + q)
            before = back.common(n - at - q, n - at)
            self._keep(i[part], q, before, after, np.ones(len(at), bool))


def _where(mask: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    at = np.flatnonzero(mask)
    return tuple(c[at] for c in columns)


def _smallest_periods(found: list[np.ndarray]) -> np.ndarray:
    """Of the stretches (start, end, period) found, each with its smallest period, by start, then period."""
    if not found:
        return np.zeros((0, 3), np.int64)
    start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return np.stack([start[order], end[order], period[order]], axis=1)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


def text_runs(texts: list[list[bytes]], shortest: int = SHORTEST) -> list[np.ndarray]:
    """(start, length, period) of the runs of each text, given as its words."""
    ids = _Ids()
    sizes = np.array([len(t) for t in texts], np.int64)
    rows = [np.fromiter(map(ids.__getitem__, t), np.int64, len(t)) for t in texts]
    row = np.concatenate([np.append(r, len(ids) + 1 + k) for k, r in enumerate(rows)])
    batch = Batch(row, sizes, shortest)
    runs = batch.runs()
    cuts = np.searchsorted(runs[:, 0], batch.begins)
    out = []
    for k in range(len(texts)):
        own = runs[cuts[k] : cuts[k + 1]]
        out.append(np.stack([own[:, 0] - batch.begins[k], own[:, 1] - own[:, 0], own[:, 2]], axis=1))
    return out


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, without those that a run contains after its first period."""
    if len(runs):
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
    return b" ".join(words)


RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def find_runs(docs: DataFrame, shortest: int = SHORTEST, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_words, runs and collapsed of every row of ``docs`` (doc_id, text).

    runs has the start (word number), length and period of every run of at least
    ``shortest`` words, by start, then period; collapsed are the words left when each run keeps
    its first period only, one space apart. ``rewrite`` may change a document's words
    before. Null, empty and blank texts have no words, no run, and collapse to
    the empty text. Repeated rows and null ids are judged each for itself; an
    empty table gives no rows; other columns are ignored. A task holds one text,
    with some 200 bytes of work for each of its words.
    """

    def scan(batches):
        for batch in batches:
            for part in _portions(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                texts = [words if rewrite is None else rewrite(i, words) for i, words in part]
                found = text_runs(texts, shortest)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _ in part], pa.int64()),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs.tolist()] for runs in found], RUNS_ARROW),
                        pa.array([_collapsed(t, r).decode("utf-8", "surrogatepass") for t, r in zip(texts, found)], pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string")


def _portions(ids: list, texts: list) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Rows with their words, some BATCH_WORDS at a time."""
    part, held = [], 0
    for i, text in zip(ids, texts):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if part and held + len(words) > BATCH_WORDS:
            yield part
            part, held = [], 0
        part.append((i, words))
        held += len(words)
    if part:
        yield part


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period), runs_sha256 and collapsed_sha256."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    best = F.struct(*[(best[c] if k == 0 else -best[c]).alias(n) for k, (c, n) in enumerate(
        (("length", "length"), ("col2", "start"), ("col3", "period")))])
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return (
        found.withColumn("best", best)
        .withColumn("listed", F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""))
        .select(
            "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"),
            F.col("best.length").alias("length"), F.col("best.period").alias("period"),
            F.expr("1000 * best.length div best.period").alias("exponent_milli"),
            F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the query: in every tenth document, by the crc32 of its id, they repeat with a period from some word on."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]
