"""Merkle manifest of a table of documents, verified by a climb in recursive SQL.

Every row is a leaf. The leaves of a source stand in order of doc_id; runs of 16
consecutive nodes become their digest until one node, the subroot, remains, and
the subroots become the root in the same way. What is stored is one row a run:
its children's digests, and the run and place it takes part in one level up. A
recursive query walks these links from the lowest runs to the root.

The leaves of one run share all siblings above their own run, so the query has
one row a run: the siblings met so far, written once instead of 16 times, and the
folded digest of each tampered leaf and of the original ones, which are one from
the first run on. Digests are kept as 32 bytes and hashed as hex text. Nothing is
gathered by source: places come from a range sort and prefix sums, and each
grouping has at most 16 rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierflow.llm.ranking import ranked
from courierflow.session import written

FAN = 16
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = "/"  # the tree over the sources; names of sources begin with "=" or are "-"
BROADCAST_BYTES = 32 << 20  # of the runs above the lowest; more are joined by a shuffle
RUN_BYTES = 700  # of one such run, at most, names of sources apart
NO_ROWS = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[framed(v) for v in values]), 256))


def as_text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def digest_of(digests: Column) -> Column:
    """The digest of digests that stand one after the other."""
    return F.unhex(F.sha2(as_text(digests), 256))


def _every_fifth(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _runs(nodes: DataFrame, level: int, *carried: str) -> DataFrame:
    """One row for FAN consecutive ``nodes`` (tree, idx, size, hash); each carried column becomes an array in their order."""
    found = F.array_sort(F.collect_list(F.struct("idx", "hash", *carried)))
    children = F.expr("aggregate(found.hash, cast('' as binary), (done, x) -> concat(done, x))")
    return (
        nodes.groupBy("tree", F.expr(f"idx div {FAN}").alias("run"), "size")
        .agg(found.alias("found"))
        .select("tree", "run", "size", F.lit(level).alias("level"), children.alias("children"), *[F.col("found").getField(c).alias(c) for c in carried])
        .withColumn("digest", F.when(F.col("size") == 1, F.col("children")).otherwise(digest_of(F.col("children"))))
    )


def _levels(first: DataFrame, most: int) -> list[DataFrame]:
    """The runs of all levels above the written runs ``first``; ``most`` is the size of the largest tree."""
    found = [first]
    while (most := -(-most // FAN)) > 1:
        below = found[-1].where(F.col("size") > FAN)
        nodes = below.select(
            "tree", F.col("run").alias("idx"), F.expr(f"(size + {FAN - 1}) div {FAN}").alias("size"), F.col("digest").alias("hash")
        )
        found.append(written(_runs(nodes, len(found)), "runs"))
    return found


def _most(runs: DataFrame) -> int:
    return runs.agg(F.max("size")).first()[0] or 0


def _linked(runs: DataFrame, tops: DataFrame) -> DataFrame:
    """``runs`` with the run one level up and the place there: null for the last run of all.

    ``tops`` has the place (tree, rank) of each tree in the tree over the sources.
    """
    inner = runs.where(F.col("size") > FAN).select(
        "*", F.col("tree").alias("up_tree"), (F.col("level") + 1).alias("up_level"),
        F.expr(f"run div {FAN}").alias("up_run"), (F.col("run") % FAN).cast("int").alias("up_pos"),
    )
    last = runs.where(F.col("size") <= FAN).join(tops, "tree", "left")
    last = last.select(
        *runs.columns, F.when(F.col("rank").isNotNull(), F.lit(TOP)).alias("up_tree"),
        F.when(F.col("rank").isNotNull(), F.lit(0)).alias("up_level"),
        F.expr(f"rank div {FAN}").alias("up_run"), (F.col("rank") % FAN).cast("int").alias("up_pos"),
    )
    return inner.unionByName(last)


def manifest(docs: DataFrame, tampered: Column | None = None, tampering=_lower_ascii) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``.

    ``docs`` has the columns of LEAF_COLUMNS. Where ``tampered`` holds (by default, where 5 divides
    the crc32 of doc_id), the digest folded up to the root is that of a row whose
    text went through ``tampering``; the siblings are the original ones, and ``verified`` says
    whether the fold arrives at the root.

    Null values have a frame of their own (``-``), so null and empty texts are
    different leaves. Rows without doc_id come first in their source and are never
    tampered with by default; rows that repeat a doc_id are leaves of their own, in order of their
    digests. A null source is a source of its own, the first. An empty table gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    changed = _every_fifth(F.col("doc_id")) if tampered is None else tampered
    plain = [F.col(c) for c in LEAF_COLUMNS]
    altered = [tampering(c) if n == "text" else c for n, c in zip(LEAF_COLUMNS, plain)]
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("tree"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        leaf_digest(*plain).alias("hash"),
        F.when(changed, leaf_digest(*altered)).alias("other"),
    )
    lowest = written(_runs(ranked(leaves, "doc_id", "hash"), 0, "doc_id", "other"), "runs")
    if not (most := _most(lowest)):
        return spark.createDataFrame([], NO_ROWS)
    levels = _levels(lowest, most)
    every = levels[0].drop("doc_id", "other")
    for level in levels[1:]:
        every = every.unionByName(level)
    subroots = every.where(F.col("size") <= FAN).select(
        F.lit(TOP).alias("tree"), F.col("tree").alias("name"), F.col("digest").alias("hash"), (F.col("tree") != "-").alias("named")
    )
    placed = written(ranked(subroots, "named", "name"), "subroots")
    tops = placed.where("size > 1").select(F.col("name").alias("tree"), F.col("idx").alias("rank"))
    upper = [] if _most(placed) < 2 else _levels(written(_runs(placed, 0), "runs"), _most(placed))
    root = (upper[-1].where(F.col("size") <= FAN).first()["digest"] if upper else placed.first()["hash"])

    nodes = _linked(every.where("level > 0"), tops)
    for level in upper:
        nodes = nodes.unionByName(_linked(level, tops))
    nodes = written(nodes.select("tree", "level", "run", "children", "up_tree", "up_level", "up_run", "up_pos"), "nodes")
    climbed = written(_climb(_linked(lowest, tops), _sized(nodes)), "climbed")

    rows = climbed.join(lowest.select("tree", "run", "children", "doc_id", "other"), ["tree", "run"])
    rows = rows.select("*", F.posexplode(F.arrays_zip("doc_id", "other")).alias("pos", "child"))
    earlier = F.size(F.filter(F.slice("other", 1, F.col("pos")), lambda x: x.isNotNull()))
    folded = F.col("folds")[F.when(F.col("child.other").isNull(), 0).otherwise(earlier + 1)]
    siblings = F.expr("concat(substring(children, 1, 32 * pos), substring(children, 32 * pos + 33))")
    root = F.lit(bytes(root))
    return rows.select(
        F.col("child.doc_id").alias("doc_id"),
        as_text(F.expr("substring(children, 32 * pos + 1, 32)")).alias("leaf"),
        as_text(F.coalesce("subroot", root)).alias("subroot"),
        as_text(root).alias("root"),
        F.sha2(as_text(F.concat(siblings, "proof")), 256).alias("proof_sha256"),
        as_text(folded).alias("folded_root"),
        (folded == root).alias("verified"),
    )


def _sized(nodes: DataFrame) -> DataFrame:
    """``nodes``, broadcast while they are within BROADCAST_BYTES."""
    size = nodes.agg(F.sum(F.lit(RUN_BYTES) + 2 * F.octet_length("tree"))).first()[0] or 0
    return F.broadcast(nodes) if size <= BROADCAST_BYTES else nodes


def _climb(lowest: DataFrame, nodes: DataFrame) -> DataFrame:
    """tree, run, folds, proof and subroot of every lowest run once it has reached the root.

    folds[0] is the digest that arrives at the root from the original leaves, and the
    next ones those that arrive when one child is replaced by its other digest, for each child that has
    one; proof has the siblings from the run's own digest upwards; subroot is null
    where there is one source only.
    """
    spark = lowest.sparkSession
    name = uuid.uuid4().hex[:12]
    lowest.createOrReplaceTempView(f"lowest_{name}")
    nodes.createOrReplaceTempView(f"nodes_{name}")
    return spark.sql(
        f"""
        with recursive climb as (
          select tree, run,
            transform(
              concat(array(children), transform(filter(zipped, x -> x.other is not null), x ->
                concat(substring(children, 1, 32 * x.k), x.other, substring(children, 32 * x.k + 33)))),
              x -> if(size = 1, x, unhex(sha2(lower(hex(x)), 256)))) as folds,
            cast('' as binary) as proof, cast(null as binary) as subroot, up_tree, up_level, up_run, up_pos
          from (select *, transform(other, (x, k) -> named_struct('k', k, 'other', x)) as zipped from lowest_{name})
          union all
          select c.tree, c.run,
            transform(c.folds, f -> unhex(sha2(lower(hex(concat(
              substring(n.children, 1, 32 * c.up_pos), f, substring(n.children, 32 * c.up_pos + 33)))), 256))),
            concat(c.proof, substring(n.children, 1, 32 * c.up_pos), substring(n.children, 32 * c.up_pos + 33)),
            if(n.tree = '{TOP}' and n.level = 0, substring(n.children, 32 * c.up_pos + 1, 32), c.subroot),
            n.up_tree, n.up_level, n.up_run, n.up_pos
          from climb c join nodes_{name} n on n.tree = c.up_tree and n.level = c.up_level and n.run = c.up_run
        )
        select tree, run, folds, proof, subroot from climb where up_tree is null
        """
    )
