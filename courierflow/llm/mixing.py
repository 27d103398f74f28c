"""Mixing of sources to target weights, to the word.

Documents get hash-random keys. The keys are uniform, so their leading digits cut
each source into even ranges, however large the source; sums of the ranges and a
running sum within each range give every document its place in its source. The
source's budget is then cut at the exact word, after whole epochs if the budget
exceeds the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courierflow.session import written

WORD = r"[^\x20\x09-\x0D]+"
WORD_AND_GAP = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
WEIGHTS = 3  # sources weigh 1 to WEIGHTS in turn
MOST_EPOCHS = 3
RANGE_DIGITS = 3  # 16**3 key ranges a source


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def _keyed(docs: DataFrame, *carried: Column) -> DataFrame:
    """source, its name as a key that is never null, size, and the random key of each row."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        F.col("doc_id").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source_key"),
        word_count(F.col("text")).alias("size"),
        key.alias("key"),
        *carried,
    ).withColumn("range", F.substring("key", 1, RANGE_DIGITS))


def source_targets(sizes: DataFrame) -> DataFrame:
    """source_key, source_size, target from the sizes of the documents.

    Targets share the total by weight and stop at MOST_EPOCHS times the source;
    what is over goes to the others by weight. With the sources ordered by cap
    per weight, the level at which the rest share is the highest of the levels
    reached by capping the first 0, 1, 2, ... of them. One row a source.
    """
    sources = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    name_order = Window.orderBy(F.col("source_key") == "", "source_key")
    all_rows = Window.partitionBy(F.lit(1))
    ranked = sources.withColumn("place", F.row_number().over(name_order))
    ranked = ranked.withColumn("weight", (F.col("place") - 1) % WEIGHTS + 1).withColumn("cap", F.col("source_size") * MOST_EPOCHS)
    by_cap = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left.cast("double") / F.sum("weight").over(after).cast("double")
    return (
        ranked.withColumn("level", level)
        .withColumn("level", F.max("level").over(all_rows))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
        .select("source_key", "source_size", "target")
    )


def _taken(keyed: DataFrame, sizes: DataFrame) -> DataFrame:
    """``keyed`` with source_size, target, epochs and part: words taken of the document after its whole epochs."""
    ranges = sizes.groupBy("source_key", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("ranges_before", F.coalesce(F.sum("range_size").over(earlier), F.lit(0))).drop("range_size")
    known = ranges.join(source_targets(sizes), "source_key")
    within = Window.partitionBy("source_key", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(known, ["source_key", "range"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = budget - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before") - F.col("ranges_before")))
    return placed.withColumn("epochs", epochs).withColumn("part", part.cast("bigint"))


def mix_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every row of ``docs`` (doc_id, text, source).

    A null text has size 0 and a null source is a source of its own, the last.
    The order within a source is that of a digest of doc_id, so reruns agree;
    rows that repeat a doc_id are documents of their own, in order of size. An
    empty table gives no rows; other columns are ignored.
    """
    sizes = written(_keyed(docs), "sizes")
    taken = F.col("size") * F.col("epochs") + F.col("part")
    return _taken(sizes, sizes).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken.

    A document at which a budget ends is there once with only its first words,
    and n_chars, if there is such a column, follows its text. Documents without
    words, and those never taken, are left out. Rows that repeat a doc_id are documents of
    their own, and an empty table stays empty.
    """
    # the whole row travels in one column, so no name of it can clash
    sizes = written(_keyed(docs), "sizes")
    rows = _taken(_keyed(docs, F.struct("*").alias("row")), sizes)
    whole = F.col("epochs") + F.when(F.col("part") == F.col("size"), 1).otherwise(0)
    cut = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    some = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD_AND_GAP), F.lit(0)), 1, F.col("part").cast("int")), "")
    copies = F.when(F.col("size") > 0, whole).otherwise(0).cast("int")
    turns = F.when(copies > 0, F.array_repeat(F.lit(False), copies)).otherwise(F.array().cast("array<boolean>"))
    turns = F.when(cut, F.concat(turns, F.array(F.lit(True)))).otherwise(turns)
    rows = rows.withColumn("is_cut", F.explode(turns))
    rows = rows.withColumn("new_text", F.when(F.col("is_cut"), some).otherwise(F.col("row.text")))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("new_text").alias(c))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            out.append(F.when(F.col("is_cut"), F.length("new_text").cast(kind)).otherwise(F.col("row.n_chars")).alias(c))
        else:
            out.append(F.col("row").getField(c).alias(c))
    return rows.select(*out)
