"""Train/test splits and folds from row hashes: repeatable, without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from courierflow import domain as D
from courierflow.functions.scalars import hash_bucket, hash_position

_PREFIX_BITS = 12
_POSITION_BITS = 60


def with_split(
    df: DataFrame, id_column: str = D.ID_COLUMN, test_pct: int = 20, seed: int = 42
) -> DataFrame:
    """Mark each row train or test by its id's hash; a projection, no shuffle."""
    bucket = hash_bucket(F.col(id_column), 100, str(seed))
    return df.withColumn("split", F.when(bucket < test_pct, "test").otherwise("train"))


def with_fold(
    df: DataFrame, id_column: str = D.ID_COLUMN, folds: int | Column = 5, seed: int = 42
) -> DataFrame:
    """Mark each row with a fold number from 0; a projection, no shuffle."""
    position = hash_position(F.col(id_column), f"fold{seed}")
    count = folds if isinstance(folds, Column) else F.lit(folds)
    return df.withColumn("fold", F.pmod(position, count.cast("bigint")).cast("int"))


def with_exact_split(
    df: DataFrame,
    id_column: str,
    test_rows: Column,
    by: list[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Mark exactly ``test_rows`` rows of each group as test, in hash order.

    ``test_rows`` is an expression over ``n``, the group's row count, which is
    kept as ``group_rows``. Rows are first counted per hash prefix; that tells in
    which prefix a group's cut falls, and only rows of that prefix (1 in 4096)
    are ranked to find the last test row. The table itself is then compared with
    its group's cut, so a group holding most of it is never sorted in one task.
    """
    keys = by or []
    position = hash_position(F.col(id_column), str(seed))
    prefix = F.shiftright(position, _POSITION_BITS - _PREFIX_BITS).cast("int")
    slim = df.select(*keys, id_column, position.alias("_position"), prefix.alias("_prefix"))

    per_prefix = slim.groupBy(*keys, "_prefix").agg(F.count("*").alias("_rows"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    running = whole.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    # At most 4096 counted rows per group reach this window.
    counted = per_prefix.withColumns(
        {
            "n": F.sum("_rows").over(whole),
            "_before": F.coalesce(F.sum("_rows").over(running), F.lit(0)),
        }
    ).withColumn("_left", test_rows.cast("bigint") - F.col("_before"))
    at_cut = counted.where((F.col("_left") > 0) & (F.col("_left") <= F.col("_rows")))
    in_prefix = Window.partitionBy(*keys, "_prefix").orderBy("_position", id_column)
    last_test = (
        slim.join(at_cut.select(*keys, "_prefix", "_left"), [*keys, "_prefix"])
        .withColumn("_rank", F.row_number().over(in_prefix))
        .where(F.col("_rank") == F.col("_left"))
        .select(*keys, F.struct("_position", id_column).alias("_cut"))
    )
    sizes = per_prefix.groupBy(*keys).agg(F.sum("_rows").alias("group_rows"))
    if keys:
        placed = df.join(sizes.join(last_test, keys, "left"), keys, "left")
        cut = F.col("_cut")
    else:
        placed = df.withColumn("group_rows", sizes.scalar())
        cut = last_test.select("_cut").scalar()
    mine = F.struct(position.alias("_position"), F.col(id_column))
    is_test = F.coalesce(mine <= cut, F.lit(False))
    return placed.withColumn("split", F.when(is_test, "test").otherwise("train")).drop("_cut")
