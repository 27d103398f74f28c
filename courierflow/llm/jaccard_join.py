"""Exact Jaccard self-join of word n-gram sets by vertical partitioning.

All n-grams stand in one global order, rare ones first. A linked pair must share
one of the first few n-grams of both, which gives the candidate pairs. The order
is cut into fragments; the overlap of a pair is counted in each fragment
separately and summed per pair. With first n-grams enough for an overlap of all
but MEET - 1, a linked pair must share MEET of them, which few chance pairs do.

Groups of thousands of near copies are not expanded into pairs: within the
documents that share an n-gram, each is first compared with one hub; then all
pairs whose documents are still in different components are compared, which is
what makes the result complete.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierflow.llm.graph import components
from courierflow.llm.ranking import ranked
from courierflow.llm.sketch import bucket_counts
from courierflow.llm.words import mix, shingle_set
from courierflow.session import written

WORDS = 3
SIMILARITY = (9, 10)  # at least this fraction
ORDER_BITS = 20  # counters behind the global order, at every input size
NEED_BITS = 22
FRAGMENTS = 8
MEET = 3  # first n-grams that a linked pair must share, if its sets are that large
SET_SCHEMA = "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, prefix array<bigint>"


def _ids(texts: pa.Array, words: int):
    for text in texts:
        yield shingle_set(text.as_py(), words)


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that two different sets share with negligible probability."""
    a = int(np.add.reduce(mix(shingles + np.uint64(1)), dtype=np.uint64))
    b = int(np.bitwise_xor.reduce(mix(shingles * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)))) if len(shingles) else 0
    return a - (1 << 63), b - (1 << 63)


class Order:
    """The global order of n-grams: by rounded frequency, then by hash.

    Frequencies are those of 2**ORDER_BITS buckets. A coarser order changes how
    many candidates there are, never which pairs are found.
    """

    def __init__(self, counts: np.ndarray, fragments: int):
        self.shift = np.uint64(64 - (len(counts).bit_length() - 1))
        self.rank = np.floor(2 * np.log2(counts + 1)).astype(np.uint8)
        # where each class of frequency begins on a line of all occurrences
        share = np.bincount(self.rank, weights=counts, minlength=256)
        self.length = share / max(1.0, share.sum())
        self.begin = np.concatenate(([0.0], np.cumsum(self.length)[:-1]))
        self.fragments = fragments

    def sort(self, shingles: np.ndarray, at_most: int) -> np.ndarray:
        """The first ``at_most`` of a sorted set of n-grams."""
        key = (self.rank[(shingles >> self.shift).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (shingles >> np.uint64(8))
        return shingles[np.argsort(key, kind="stable")[:at_most]]

    def fragment(self, shingles: np.ndarray) -> np.ndarray:
        rank = self.rank[(shingles >> self.shift).astype(np.int64)]
        place = self.begin[rank] + self.length[rank] * (shingles.astype(np.float64) / 2.0**64)
        return np.minimum((place * self.fragments).astype(np.int64), self.fragments - 1)


def least_overlap(a, b, similarity: tuple[int, int] = SIMILARITY):
    """The smallest overlap of two sets of these sizes that makes a link."""
    num, den = similarity
    return F.ceil(num * (a + b) / (num + den))


def global_order(docs: DataFrame, words: int = WORDS, fragments: int = FRAGMENTS) -> Order:
    texts = docs.select("text")
    return Order(bucket_counts(texts, lambda batch: _ids(batch.column(0), words), ORDER_BITS), fragments)


def shingle_sets(docs: DataFrame, order: Order, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Per row of ``docs``: size and digest of its set, and its first n-grams."""
    num, den = similarity
    held = docs.sparkSession.sparkContext.broadcast(order)

    def scan(batches):
        for batch in batches:
            sizes, h1, h2, prefixes = [], [], [], []
            for s in _ids(batch.column(1), words):
                n = len(s)
                a, b = _digest(s)
                sizes.append(n)
                h1.append(a)
                h2.append(b)
                first = held.value.sort(s, n - -(-num * n // den) + MEET if n else 0)
                prefixes.append(first.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(h1, pa.int64()),
                    pa.array(h2, pa.int64()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "h1", "h2", "prefix"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scan, SET_SCHEMA)


def segments(docs: DataFrame, needed: np.ndarray, order: Order, words: int = WORDS) -> DataFrame:
    """(node, fragment, h1, h2, grams) of the documents whose id is in the bit map ``needed``."""
    held = docs.sparkSession.sparkContext.broadcast((needed, order))
    bits = len(needed).bit_length() + 2  # 8 bits a byte

    def scan(batches):
        bitmap, order = held.value
        for batch in batches:
            places = _places(batch.column(0), bits)
            wanted = np.flatnonzero((bitmap[places >> 3] >> (places & 7)) & 1)
            out = []
            for i in wanted:
                s = shingle_set(batch.column(1)[int(i)].as_py(), words)
                if len(s) == 0:
                    continue
                h1, h2 = _digest(s)
                which = order.fragment(s)
                for f in np.unique(which):
                    out.append((batch.column(0)[int(i)].as_py(), int(f), h1, h2, s[which == f].view(np.int64)))
                if len(out) > 2000:
                    yield _segment_batch(out)
                    out = []
            if out:
                yield _segment_batch(out)

    return (
        docs.where("doc_id is not null")
        .select(F.col("doc_id").cast("bigint"), "text")
        .mapInArrow(scan, "node bigint, fragment int, h1 bigint, h2 bigint, grams array<bigint>")
    )


def _segment_batch(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["node", "fragment", "h1", "h2", "grams"]
    )


def _places(ids: pa.Array, bits: int) -> np.ndarray:
    numbers = np.asarray(ids.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
    return (mix(numbers) >> np.uint64(64 - bits)).astype(np.int64)


def verified(
    pairs: DataFrame, docs: DataFrame, order: Order, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY
) -> DataFrame:
    """Those pairs (a, b, size_a, size_b) whose overlaps, summed over the fragments, make a link."""
    parts = _parts(docs, pairs, order, words)
    cut = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    left = parts.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("grams_a"))
    right = parts.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("grams_b"))
    partial = cut.join(left, ["a", "fragment"]).join(right, ["b", "fragment"])
    counted = partial.select("a", "b", "size_a", "size_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("shared"))
    total = counted.groupBy("a", "b", "size_a", "size_b").agg(F.sum("shared").alias("shared"))
    return total.where(F.col("shared") >= least_overlap(F.col("size_a"), F.col("size_b"), similarity)).select("a", "b")


def jaccard_groups(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Texts are compared as sets of lower-cased (A-Z) ``words``-word shingles; two
    documents link if overlap / union is at least ``similarity`` (a fraction as two
    whole numbers, compared without rounding). Documents with equal sets are
    one class, represented by the smallest id.

    Null or blank texts have no shingle and link with nothing. Rows with a null
    doc_id have a null component_id. Rows that repeat a doc_id are one document;
    if their texts differ, the set with the smallest digest stands for it in
    links, while n_shingles is the row's own. An empty table gives no rows.
    Other columns are ignored.
    """
    order = global_order(docs, words)
    sets = written(shingle_sets(docs, order, words, similarity), "shingle-sets")
    own = (
        sets.where("doc_id is not null and n_shingles > 0")
        .groupBy("doc_id")
        .agg(F.min(F.struct("h1", "h2", "n_shingles", "prefix")).alias("s"))
        .select("doc_id", "s.*")
    )
    classes = written(
        own.groupBy("h1", "h2").agg(
            F.min("doc_id").alias("node"), F.first("n_shingles").alias("size"), F.first("prefix").alias("prefix")
        ),
        "shingle-classes",
    )
    postings = _shared_postings(classes, similarity)

    hubs = postings.groupBy("gram").agg(F.min(F.struct("place", "node", "size")).alias("hub"))
    near = postings.join(hubs, "gram").select(
        "node", "place", "size", F.col("hub.node").alias("node2"), F.col("hub.place").alias("place2"), F.col("hub.size").alias("size2")
    )
    links = written(verified(written(_pairs(near, similarity), "jaccard-pairs"), docs, order, words, similarity), "jaccard-links")
    roots = components(links)

    rooted = postings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = rooted.groupBy("gram").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("gram")
    rest = written(rooted.join(split, "gram", "left_semi"), "jaccard-rest")
    other = rest.select("gram", *[F.col(c).alias(c + "2") for c in ("node", "place", "size", "root")])
    # of two orders of a pair one, so that it comes once for each shared n-gram
    apart = rest.join(
        other,
        (rest["gram"] == other["gram"])
        & (F.col("root") != F.col("root2"))
        & (F.col("node") < F.col("node2"))
        & _viable(similarity),
    ).select("node", "place", "size", "node2", "place2", "size2")
    more = written(verified(written(_pairs(apart, similarity), "jaccard-pairs"), docs, order, words, similarity), "jaccard-links")
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    member = own.select("doc_id", "h1", "h2").join(classes.select("h1", "h2", "node"), ["h1", "h2"])
    member = member.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("component_id"))
    return (
        sets.select("doc_id", "n_shingles")
        .join(member, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def _shared_postings(classes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(gram, node, place, size) of the first n-grams that another document has among its first ones.

    A document can link only if enough n-grams follow ``place``, counted against
    the smallest size that shares the n-gram.
    """
    postings = classes.select("node", "size", F.posexplode("prefix").alias("place", "gram"))
    seen = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least")).where("n > 1").drop("n")
    num, den = similarity
    size = F.col("size")
    partner = F.greatest("least", F.ceil(num * size / den))
    enough = size - F.col("place") + MEET - 1 >= least_overlap(size, partner, similarity)
    return written(
        postings.join(seen, "gram").where(enough).select("gram", "node", "place", "size"),
        "jaccard-postings",
    )


def _viable(similarity: tuple[int, int]):
    """Whether a pair for which these places are among the first MEET shared ones can overlap enough."""
    num, den = similarity
    a, b = F.col("size"), F.col("size2")
    left = F.least(a - F.col("place"), b - F.col("place2"))
    return (left + MEET - 1 >= least_overlap(a, b, similarity)) & (den * F.least(a, b) >= num * F.greatest(a, b))


def _pairs(near: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Each pair once, if it shares enough of its first n-grams."""
    first = F.col("node") > F.col("node2")
    pairs = near.where((F.col("node") != F.col("node2")) & _viable(similarity)).select(
        F.greatest("node", "node2").alias("a"),
        F.least("node", "node2").alias("b"),
        F.when(first, F.col("size")).otherwise(F.col("size2")).alias("size_a"),
        F.when(first, F.col("size2")).otherwise(F.col("size")).alias("size_b"),
    )
    met = pairs.groupBy("a", "b", "size_a", "size_b").agg(F.count(F.lit(1)).alias("met"))
    return met.where(F.col("met") >= F.least(F.lit(MEET), least_overlap(F.col("size_a"), F.col("size_b"), similarity))).drop("met")


def _parts(docs: DataFrame, pairs: DataFrame, order: Order, words: int) -> DataFrame:
    """Segments of every document in ``pairs`` (and of a few others, by the bit map)."""

    def hashes(batch):
        for column in batch.columns:
            yield mix(np.asarray(column.to_numpy(zero_copy_only=False), np.int64).view(np.uint64))

    needed = np.packbits(bucket_counts(pairs.select("a", "b"), hashes, NEED_BITS) > 0, bitorder="little")
    cut = segments(docs, needed, order, words)
    return cut.groupBy("node", "fragment").agg(F.min_by("grams", F.struct("h1", "h2")).alias("grams"))


def keep_one(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id.

    Rows equal in doc_id and text are one document, of which one row stays. Texts that
    share an id with other texts are documents of their own; they come after all others, in
    the order of their ids, then of a digest of the text. Rows without doc_id belong to no
    group and all stay, and so do documents without a word. An empty table stays empty.
    """
    # the whole row travels in one column, so no name of it can clash
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("node"),
        F.coalesce(F.md5("text"), F.lit("")).alias("text_key"),
    )
    texts = written(rows.where("node is not null").groupBy("node", "text_key").agg(F.count(F.lit(1)).alias("n")), "texts-of-ids")
    shared = texts.groupBy("node").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("node")
    if not shared.isEmpty():
        rows = _numbered(rows, texts, shared)
        texts = rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    groups = jaccard_groups(rows.select(F.col("node").alias("doc_id"), F.col("row.text").alias("text")), words, similarity)
    dropped = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("node"))
    repeated = texts.where("n > 1").select("node")
    single = rows.join(dropped.unionByName(repeated).distinct(), "node", "left_anti").select("row")
    # of repeated rows one, chosen before anything is shuffled
    left = repeated.join(dropped.distinct(), "node", "left_anti")
    digest = F.xxhash64("row")
    one = rows.join(left, "node", "left_semi").groupBy("node").agg(F.min_by("row", digest).alias("row")).select("row")
    return single.unionByName(one).select([F.col("row").getField(c).alias(c) for c in docs.columns])


def _numbered(rows: DataFrame, texts: DataFrame, shared: DataFrame) -> DataFrame:
    """``rows`` with a number of its own, beyond all ids, as node of each text that shares its id with others."""
    own = texts.join(shared, "node", "left_semi").select(F.lit("").alias("tree"), "node", "text_key")
    numbers = ranked(own, "node", "text_key").select("node", "text_key", "idx", "size")
    low, high = texts.agg(F.min("node"), F.max("node")).first()
    first = F.lit(high + 1) if high < 1 << 62 else F.lit(low) - F.col("size")
    numbers = numbers.select("node", "text_key", (first + F.col("idx")).alias("number"))
    return written(
        rows.join(numbers, ["node", "text_key"], "left").select("row", F.coalesce("number", "node").alias("node"), "text_key"), "numbered"
    )
