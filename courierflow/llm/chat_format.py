"""Reply trees as training conversations.

Messages point to the message they reply to. Self-joins that double their reach
give every message its root, depth and path score; branches are ranked by score,
and each chosen root-to-leaf path becomes one conversation in a template whose
control strings no message can forge.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courierflow.session import written

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
LOSS_ROLE = "assistant"
# Control strings of this and other templates, without their first character.
# Inside messages a backslash is put after that character, one more than there is.
RESTS = r"\|turn\|>|\|text\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>"
ESCAPE = rf"([<\[])(\\*)({RESTS})"
UNESCAPE = re.compile(rf"([<\[])\\(\\*)({RESTS})")
MOST_ROUNDS = 62  # paths of up to 2**62 messages


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def root_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """tree_id, path_id, rank, node_id, depth: the messages on the ``best`` best paths of each tree.

    ``messages`` has tree_id, node_id (unique in its tree), parent_id and score.
    A path leads from a root (a message whose parent is null or not there) to a
    message without replies; its score is the sum of its messages' scores, ties
    go to the smaller leaf. Messages on a cycle have no root and are on no path.
    """
    base = written(messages.select("tree_id", "node_id", "parent_id", F.coalesce("score", F.lit(0.0)).alias("score")), "messages")

    def above(jump: DataFrame) -> DataFrame:
        return jump.select(*[F.col(c).alias(f"{c}_2") for c in jump.columns])

    # jump k: the message 2**k steps up, with the steps and the score on the way there
    there = above(base.select("tree_id", "node_id"))
    same = F.col("tree_id").eqNullSafe(F.col("tree_id_2"))
    jump = base.join(there, same & (F.col("parent_id") == F.col("node_id_2")), "left").select(
        "tree_id", "node_id", F.col("node_id_2").alias("up"), F.lit(1).cast("bigint").alias("steps"), "score"
    )
    jumps = []
    for _ in range(MOST_ROUNDS):
        jump = written(jump, "jump")
        jumps.append(jump)
        open_rows = jump.where("up is not null")
        more, longest = jump.agg(F.count("up"), F.count(F.lit(1))).first()
        if not more or 1 << (len(jumps) - 1) > longest:  # beyond that only cycles go on
            break
        joined = open_rows.join(above(jump), same & (F.col("up") == F.col("node_id_2")))
        jump = joined.select(
            "tree_id", "node_id", F.col("up_2").alias("up"), (F.col("steps") + F.col("steps_2")).alias("steps"), (F.col("score") + F.col("score_2")).alias("score")
        ).unionByName(jump.where("up is null"))
    ended = jump.where("up is null")
    parents = base.select(F.col("tree_id").alias("tree_id_2"), F.col("parent_id").alias("node_id_2")).where("node_id_2 is not null")
    leaves = ended.join(parents, same & (F.col("node_id") == F.col("node_id_2")), "left_anti")
    order = Window.partitionBy("tree_id").orderBy(F.col("score").desc(), "node_id")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    path = written(chosen.select("tree_id", F.col("node_id").alias("path_id"), "rank", "node_id"), "paths")
    # by falling reach, each message of a path is met exactly once
    for step in reversed(jumps):
        higher = path.join(above(step), same & (F.col("node_id") == F.col("node_id_2")))
        higher = higher.where("up_2 is not null").select("tree_id", "path_id", "rank", F.col("up_2").alias("node_id"))
        path = written(path.unionByName(higher), "paths")
    depth = ended.select(F.col("tree_id").alias("tree_id_2"), F.col("node_id").alias("node_id_2"), "steps")
    return path.join(depth, same & (F.col("node_id") == F.col("node_id_2"))).select(
        "tree_id", "path_id", "rank", "node_id", F.col("steps").alias("depth")
    )


def format_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """tree_id, path_id, rank, formatted, loss_spans of the ``best`` best paths of each tree.

    ``messages`` has tree_id, node_id, parent_id, role, text and score. Null roles
    and texts are empty. Each message is marked as TURN role TEXT text END, and
    loss_spans (start, length, in code points of ``formatted``) are the texts of
    assistant messages. A conversation is one row and so must fit into a string.
    """
    empty = F.lit("")
    said = messages.select(
        F.col("tree_id").alias("tree_id_2"),
        F.col("node_id").alias("node_id_2"),
        (F.coalesce("role", empty) == LOSS_ROLE).alias("learned"),
        F.concat(F.lit(TURN), escaped(F.coalesce("role", empty)), F.lit(TEXT)).alias("head"),
        escaped(F.coalesce("text", empty)).alias("body"),
    )
    paths = root_paths(messages, best)
    rows = paths.join(said, F.col("tree_id").eqNullSafe(F.col("tree_id_2")) & (F.col("node_id") == F.col("node_id_2")))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    earlier = Window.partitionBy("tree_id", "path_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(earlier), F.lit(0)) + F.length("head")
    rows = rows.withColumn("start", start).withColumn("length", F.length("body").cast("bigint"))
    span = F.when(F.col("learned"), F.struct("start", "length"))
    lines = F.array_sort(F.collect_list(F.struct("depth", "piece", span.alias("span"))))
    return (
        rows.groupBy("tree_id", "path_id", "rank")
        .agg(lines.alias("lines"))
        .select(
            "tree_id",
            "path_id",
            "rank",
            F.array_join(F.col("lines.piece"), "").alias("formatted"),
            F.filter("lines.span", lambda s: s.isNotNull()).alias("loss_spans"),
        )
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, text = part.partition(TEXT)
        turns.append((unescape(role), unescape(text[: -len(END)])))
    return turns


def digests(conversations: DataFrame) -> DataFrame:
    """tree_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the output.

    One row for each formatted conversation; one without assistant turns has no loss characters. An empty table gives no rows.
    """

    def read(batches):
        for batch in batches:
            rows = []
            for tree, formatted, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
                turns = parse(formatted)
                loss = [unescape(formatted[s["start"] : s["start"] + s["length"]]) for s in spans]
                whole = "".join(f"{role}\n{text}\n" for role, text in turns)
                learned = "".join(loss)
                rows.append((tree, len(turns), _sha(whole), len(learned), _sha(learned), len(formatted)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema_names)

    schema_names = ["tree_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = "tree_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return conversations.select("tree_id", "formatted", "loss_spans").mapInArrow(read, schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def as_chains(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as reply trees without branches.

    Rows follow each other by turn (null first), then role and text, so repeated
    rows stay apart. Rows with a null conv_id are one conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("bigint"), "turn", "role", "text").withColumn("node_id", F.row_number().over(order))
    return rows.select(
        F.col("conv_id").alias("tree_id"),
        "node_id",
        F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"),
        "role",
        "text",
        F.lit(1.0).alias("score"),
    )
