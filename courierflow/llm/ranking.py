"""Exact places of rows within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courierflow.session import written

ROW_BITS = 33  # monotonically_increasing_id keeps the row of its partition in so many bits


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (with a column tree) plus idx, the place within the tree by ``order``, and size, the rows of the tree.

    A range sort over (tree, order) cuts large trees into many partitions; each row
    keeps its partition and its place there in a written table, so both stay what
    they are when tasks are repeated, and the partitions' counts are added up.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order]
    placed = written(
        rows.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("row", ROW_BITS).cast("int")),
        "ranked",
    )
    per = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "tree", "part",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(whole).alias("size"),
    )
    return placed.join(per, ["tree", "part"]).withColumn("idx", F.col("row") + F.col("shift")).drop("row", "part", "shift")
