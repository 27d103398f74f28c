"""Quality rules whose cutoffs carry a guarantee.

The rules are joined into one score per stratum, learned from the documents
labelled bad and from those without a label. The documents labelled good are the
holdout: cutoffs of the score are tested from mild to strict, and one is allowed
only if an exact binomial test shows that it rejects at most a given share of
good documents. The tests of a stratum stop at the first that fails, so only the
number of strata divides the error. Strata with too few good documents for any
test are pooled.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierflow.llm.words import SPACE, as_bytes, grams, spans, word_hashes
from courierflow.session import written

WINDOW = 5
MOST_FALSE_REJECTIONS = 0.01  # of good documents of a stratum or pool
ERROR = 0.05  # chance that any of the guarantees fails
CAUGHT = 0.95  # of the bad documents that the tightest allowed cutoff rejects
BINS = 200
STEPS = 100  # of the score, to a natural logarithm
PRIOR = 1.0  # rows that the learned shares are smoothed with
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
# A rule is a share between 0 and 1, the larger the worse.
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "long_words": "least(1, word_chars / greatest(n_words, 1) / 40)",
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
STRATUM = "lang"


def measure(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one text; a null text counts as empty."""
    data = as_bytes(text)
    words = word_hashes(data)
    windows = grams(words, WINDOW)
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[which] > 1) if len(windows) else np.zeros(0, np.int64)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + WINDOW, -1)
    solid = data[~SPACE[data]]
    lines = [line for line in (text or "").split("\n") if line.strip(" \t\v\f\r")]
    return (
        len(words),
        int(((solid & 0xC0) != 0x80).sum()),  # bytes that begin a character
        int(SYMBOLS[data].sum()),
        len(lines) - len(set(lines)),
        int((np.cumsum(edges[:-1]) > 0).sum()),
        len(lines),
        int(((solid >= 65) & (solid <= 90)).sum()),
    )


def features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and COUNTS of every row; a null stratum is one of its own."""
    names = ["doc_id", "stratum", *COUNTS]

    def scan(batches):
        for batch in batches:
            rows = [measure(text.as_py()) for text in batch.column(2)]
            columns = list(zip(*rows)) if rows else [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in columns]], names
            )

    schema = "doc_id bigint, stratum string, " + ", ".join(f"{c} bigint" for c in COUNTS)
    stratum = F.coalesce(F.concat(F.lit("="), F.col(STRATUM).cast("string")), F.lit("")).alias("stratum")
    return docs.select(F.col("doc_id").cast("bigint"), stratum, "text").mapInArrow(scan, schema)


def most_rejected(n: int, share: float, error: float) -> int:
    """The largest k of n rejections that shows, with at most ``error``, a true share of at most ``share``; else -1.

    The exact binomial test: the chance of k or fewer at that share is at most ``error``.
    """
    total, k = 0.0, 0
    while k <= n:
        log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share)
        total += math.exp(log)
        if total > error:
            return k - 1
        k += 1
    return n


@dataclass
class Group:
    """Strata that share a score and a cutoff."""

    strata: tuple[str, ...]  # that are judged by it
    learned: tuple[str, ...]  # whose labels it is learned from and tested on
    steps: dict[str, np.ndarray] = field(default_factory=dict)  # by rule: the score of each bin
    last: int | None = None  # score that is still kept; None: no cutoff


def grouped(good: dict[str, int], share: float, error: float) -> tuple[list[Group], float]:
    """Strata with enough good documents by themselves, the others as one pool, and the error left to each group.

    Numbers of documents alone decide this, not what is rejected of them. Strata
    next in size are learned from in the pool as long as it has too few itself.
    """
    names = sorted(good, key=lambda s: (-good[s], s))
    for own in range(len(names), -1, -1):
        each = error / max(1, own + (own < len(names)))
        if own == 0 or most_rejected(good[names[own - 1]], share, each) >= 0:
            break
    groups = [Group((s,), (s,)) for s in names[:own]]
    if own < len(names):
        first = own
        while first > 0 and most_rejected(sum(good[s] for s in names[first:]), share, each) < 0:
            first -= 1
        groups.append(Group(tuple(names[own:]), tuple(names[first:])))
    return groups, each


def score_steps(bad: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """By bin: how much commoner its value or a worse one is among bad documents than among those without a label.

    In STEPS of the logarithm, from 0, and never less for a worse value.
    """
    uniform = np.arange(len(unknown), 0, -1) / len(unknown)
    base = (unknown[::-1].cumsum()[::-1] + PRIOR * uniform) / (unknown.sum() + PRIOR)
    tail = (bad[::-1].cumsum()[::-1] + PRIOR * base) / (bad.sum() + PRIOR)
    return np.maximum.accumulate(np.rint(STEPS * np.maximum(0, np.log(tail / base))).astype(np.int64))


def cutoffs(measured: DataFrame, labels: DataFrame, share: float = MOST_FALSE_REJECTIONS, error: float = ERROR) -> list[Group]:
    """The groups of strata, with the score and the cutoff of each.

    ``labels`` has doc_id and quality; of repeated labels the lowest holds, rows
    without a quality are left out. What is gathered is one count per stratum,
    rule and bin, and one per stratum and score. Of the allowed cutoffs the
    mildest that still rejects CAUGHT of the bad documents that the tightest one
    rejects is taken.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality"))
    marked = binned_rules(measured).where("doc_id is not null").join(known, "doc_id", "left")
    marked = written(marked.select("stratum", F.col("quality").isNull().alias("unknown"), (F.col("quality") == 1).alias("good"), *RULES), "quality-marked")

    good = {r["stratum"]: 0 for r in measured.select("stratum").distinct().collect()}
    good.update({r["stratum"]: r["n"] for r in marked.where("good").groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()})
    groups, error = grouped(good, share, error)

    # good documents stay out of the score, since its cutoffs are tested on them
    long = marked.where("unknown or not good").select("stratum", "unknown", F.explode(F.create_map(*[x for r in RULES for x in (F.lit(r), F.col(r))])).alias("rule", "bin"))
    counts: dict[tuple[str, str, bool], np.ndarray] = {}
    for r in long.groupBy("stratum", "rule", "unknown", "bin").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault((r["stratum"], r["rule"], r["unknown"]), np.zeros(BINS + 1, np.int64))[r["bin"]] += r["n"]
    none = np.zeros(BINS + 1, np.int64)
    for g in groups:
        for rule in RULES:
            bad, unknown = (sum((counts.get((s, rule, u), none) for s in g.learned), none) for u in (False, True))
            g.steps[rule] = score_steps(bad, unknown)

    for own in (True, False):  # a stratum is tested by itself, or in the pool, or in both
        tested = [g for g in groups if (g.strata == g.learned and len(g.strata) == 1) == own]
        if not tested:
            continue
        rows = scored(marked.where("not unknown"), tested, lambda g: g.learned).where("group is not null")
        held: dict[int, dict[bool, dict[int, int]]] = {}
        for r in rows.groupBy("group", "good", "score").agg(F.count(F.lit(1)).alias("n")).collect():
            held.setdefault(r["group"], {True: {}, False: {}})[r["good"]][r["score"]] = r["n"]
        for i, by in held.items():
            tested[i].last = _last_kept(by[True], by[False], share, error)
    return groups


def _last_kept(good: dict[int, int], bad: dict[int, int], share: float, error: float) -> int | None:
    allowed = most_rejected(sum(good.values()), share, error)
    cuts, rejected, caught = [], 0, 0
    for score in sorted({*good, *bad}, reverse=True):
        # what has this score or a worse one would go
        rejected += good.get(score, 0)
        caught += bad.get(score, 0)
        if rejected > allowed or score == 0:
            break
        cuts.append((score - 1, caught))
    if not cuts or not cuts[-1][1]:
        return None
    return next(last for last, caught in cuts if caught >= CAUGHT * cuts[-1][1])


def scored(binned: DataFrame, groups: list[Group], strata: Callable[[Group], tuple[str, ...]]) -> DataFrame:
    """``binned`` with group (its place in ``groups``), score and last; these are null for a stratum in no group."""
    spark = binned.sparkSession
    tables = [(s, i, g.last, *[g.steps[r].tolist() for r in RULES]) for i, g in enumerate(groups) for s in strata(g)]
    schema = "stratum string, group int, last bigint, " + ", ".join(f"steps_{r} array<bigint>" for r in RULES)
    # one row a stratum, all of which the driver has seen
    steps = F.broadcast(spark.createDataFrame(tables, schema))
    score = sum((F.element_at(f"steps_{r}", F.col(r) + 1) for r in RULES), F.lit(0))
    return binned.join(steps, "stratum", "left").withColumn("score", score).drop(*[f"steps_{r}" for r in RULES])


def binned_rules(measured: DataFrame) -> DataFrame:
    shares = [F.least(F.floor(F.expr(sql) * BINS), F.lit(BINS)).cast("int").alias(r) for r, sql in RULES.items()]
    return measured.select("*", *shares)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every row of ``docs`` (doc_id, text, lang).

    A null text has no words and fails the base rules, as does every text of
    under 10 words. Without labels, or with too few in all strata together for a
    guarantee (299 good ones), no cutoff is set and the base rules alone decide. Rows with a null doc_id are judged but
    never learned from; repeated rows are judged each for itself; an empty table
    gives no rows; other columns are ignored.
    """
    measured = written(features(docs), "quality-features")
    groups = cutoffs(measured, labels)
    rejected = F.coalesce(F.col("score") > F.col("last"), F.lit(False))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        scored(binned_rules(measured), groups, lambda g: g.strata)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & ~rejected)
        .select("doc_id", *COUNTS[:5], "base_failed", "kept")
    )
