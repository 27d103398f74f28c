"""Quality classifier on subword embeddings.

Words, their character n-grams and repeats of the word before are hashed to
vectors; a document is the mean of all its vectors, and a softmax layer gives its class. Vectors and layer are
learned by stochastic gradient descent in numpy on a bounded sample of labelled
documents. Spark extracts the hashed features of the sample and scores all texts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_CLASS = 1200  # labelled documents learned from, of each class at most
BUCKETS = 1 << 16
DIM = 8
EPOCHS = 6
BATCH = 16
RATE = 0.05
GRAMS = (3, 4)
THRESHOLD = 0.7
HELD_WORDS = 200_000
SEED = 11
# the word pair whose second word is the first again, whatever the word
REPEAT = zlib.crc32(b"\0repeat") % BUCKETS


def word_features(word: str) -> list[int]:
    """Buckets of the word and of its character n-grams, with marks at its ends."""
    marked = f"<{word}>"
    found = [zlib.crc32(marked.encode("utf-8", "surrogatepass")) % BUCKETS]
    for n in GRAMS:
        for i in range(len(marked) - n + 1):
            found.append(zlib.crc32(marked[i : i + n].encode("utf-8", "surrogatepass"), n) % BUCKETS)
    return found


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and the share of each."""
    total: Counter[int] = Counter()
    words = (text or "").split()
    if repeats := sum(map(eq, words, words[1:])):
        total[REPEAT] = repeats
    for word, times in Counter(words).items():
        for bucket, n in Counter(word_features(word)).items():
            total[bucket] += n * times
    buckets = np.array(sorted(total), np.int32)
    counts = np.array([total[b] for b in buckets], np.float64)
    return buckets, (counts / max(1.0, counts.sum())).astype(np.float32)


def sample(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[list, dict[int, int]]:
    """Features and labels of up to PER_CLASS documents a class, by digest of the id; and all label counts.

    Of repeated labels the lowest holds; other values than 0 and 1 are left out.
    The chosen ids, at most PER_CLASS a class, meet the texts in a join.
    """
    known = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("quality"))
        .where(learn)
    )
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("quality") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS)
        chosen = part if chosen is None else chosen.unionByName(part)

    def extract(batches):
        for batch in batches:
            found = [text_features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([b.tobytes() for b, _ in found], pa.binary()),
                    pa.array([s.tobytes() for _, s in found], pa.binary()),
                ],
                ["doc_id", "quality", "buckets", "shares"],
            )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # a repeated id counts once
    rows = texts.mapInArrow(extract, "doc_id bigint, quality int, buckets binary, shares binary")
    examples = [(r["doc_id"], r["quality"], np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in rows.collect()]
    examples.sort(key=lambda e: (zlib.crc32(str(e[0]).encode()), e[0], len(e[2])))
    return examples, counts


def train(examples: list) -> tuple[np.ndarray, float]:
    """The weight of each bucket and the intercept of the learned log odds of class 1.

    The model is (mean of vectors) times a two-column softmax layer; as a sum over
    features it comes down to one number per bucket.
    """
    random = np.random.default_rng(SEED)
    vectors = random.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer = random.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    sums = [np.full(x.shape, 1e-8, np.float32) for x in (vectors, layer, bias)]  # of squared gradients
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = random.permutation(len(examples))
        for at in range(0, len(order), BATCH):
            chosen = [examples[i] for i in order[at : at + BATCH]]
            ids = np.concatenate([e[2] for e in chosen])
            shares = np.concatenate([e[3] for e in chosen])
            owner = np.repeat(np.arange(len(chosen)), [len(e[2]) for e in chosen])
            mean = np.zeros((len(chosen), DIM), np.float32)
            weighted = vectors[ids] * shares[:, None]
            for d in range(DIM):
                mean[:, d] = np.bincount(owner, weighted[:, d], minlength=len(chosen))
            logits = mean @ layer + bias
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            chance[np.arange(len(chosen)), [e[1] for e in chosen]] -= 1
            error = chance / len(chosen)
            touched, place = np.unique(ids, return_inverse=True)
            back = (error @ layer.T)[owner] * shares[:, None]
            gradient = np.stack([np.bincount(place, back[:, d], minlength=len(touched)) for d in range(DIM)], axis=1).astype(np.float32)
            sums[0][touched] += gradient**2
            vectors[touched] -= rate * gradient / np.sqrt(sums[0][touched])
            for x, g, total in ((layer, mean.T @ error, sums[1]), (bias, error.sum(axis=0), sums[2])):
                total += g**2
                x -= rate * g / np.sqrt(total)
    side = layer[:, 1] - layer[:, 0]
    return (vectors @ side).astype(np.float64), float(bias[1] - bias[0])


class Scorer:
    """Scores of whole texts, summed over their words.

    What a word adds (its weights and the number of its features) is held for the
    latest words, in two generations so that memory is bounded.
    """

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights = weights
        self.intercept = intercept
        self.newer: dict[str, complex] = {}
        self.older: dict[str, complex] = {}

    def add(self, word: str) -> complex:
        # real part: sum of weights; imaginary part: number of features
        value = self.older.get(word)
        if value is None:
            found = word_features(word)
            value = complex(math.fsum(self.weights[found].tolist()), len(found))
        if len(word) <= 100:
            if len(self.newer) >= HELD_WORDS:
                self.older, self.newer = self.newer, {}
            self.newer[word] = value
        return value

    def score(self, text: str | None) -> float:
        words = (text or "").split()
        repeats = sum(map(eq, words, words[1:]))
        total = complex(repeats * float(self.weights[REPEAT]), repeats)
        for word in words:
            value = self.newer.get(word)
            total += self.add(word) if value is None else value
        odds = self.intercept + (total.real / total.imag if total.imag else 0.0)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[np.ndarray, float]:
    """Weights and intercept; the sample's class shares are corrected to those of all labels.

    Without labels of both classes there is nothing to tell apart: every score is
    then the smoothed share of 1 among the labels, and 1 without any.
    """
    examples, counts = sample(docs, labels, learn)
    seen = Counter(e[1] for e in examples)
    if not seen[0] or not seen[1]:
        share = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 1)
        return np.zeros(BUCKETS), math.log(share / (1 - share)) if share < 1 else 500.0
    weights, intercept = train(examples)
    return weights, intercept + math.log(counts[1] / counts[0]) - math.log(seen[1] / seen[0])


def with_scores(docs: DataFrame, model: tuple[np.ndarray, float], *carried: Column) -> DataFrame:
    """The ``carried`` columns, then score, for every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*carried, F.col("text").alias("scored_text"))
    names = rows.columns[:-1]

    def predict(batches):
        scorer = Scorer(*held.value)
        for batch in batches:
            scores = [scorer.score(t.as_py()) for t in batch.column(len(names))]
            arrays = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(scores, pa.float64())], [*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", score double"
    return rows.mapInArrow(predict, schema)


def classify(docs: DataFrame, labels: DataFrame, learn: Column, held_out: Column) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= THRESHOLD) of every row of ``docs`` (doc_id, text).

    Labels are learned only where ``learn`` (a condition on doc_id) holds; a score
    depends on the text alone, all of it. Null and blank texts have the score of
    the intercept. Rows with a null doc_id are scored but never learned from;
    repeated rows are scored each for itself; an empty table gives no rows; other
    columns are ignored.
    """
    model = fit(docs, labels, learn)
    scored = with_scores(docs, model, F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns.

    Each row is judged by its text alone, so of repeated rows all stay or none; null and blank
    texts have the score of the intercept. An empty table stays empty.
    """
    model = fit(docs, labels, learn)
    scored = with_scores(docs, model, F.struct("*").alias("row"))
    return scored.where(F.col("score") >= THRESHOLD).select([F.col("row").getField(c).alias(c) for c in docs.columns])
