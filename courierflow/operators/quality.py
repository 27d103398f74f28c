"""Data-quality rules and counts. Each report is one pass with partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierflow import domain as D


class InvalidInput(ValueError):
    """Raised by the strict check when any row breaks a rule."""


def unpivot_row(one_row: DataFrame, entries: dict[str, list[Column]], names: list[str]) -> DataFrame:
    """Turn a one-row aggregate into one row per entry: its key, then its columns."""
    rows = [
        F.struct(F.lit(key).alias(names[0]), *[c.alias(n) for n, c in zip(names[1:], columns)])
        for key, columns in entries.items()
    ]
    return one_row.select(F.inline(F.array(*rows)))


def violation_codes() -> Column:
    """Array of rule codes a row breaks, in rule order.

    Missing numbers pass the range rules, but a missing distance has no distance
    category and is reported; missing categories are outside their domain.
    """
    rules = []
    for column, (low, high, open_low) in D.NUMERIC_RANGES.items():
        given, value = F.col(column), F.col(column).try_cast("double")
        too_low = value <= low if open_low else value < low
        rules.append(F.when(given.isNotNull() & value.isNull(), f"{column}_not_numeric"))
        rules.append(F.when(too_low | (value > high), f"{column}_range"))
        if column == "distance_km":
            rules.append(F.when(given.isNull(), f"{column}_null"))
    for column, levels in D.CATEGORY_DOMAINS.items():
        known = F.coalesce(F.col(column).isin(levels), F.lit(False))
        rules.append(F.when(~known, f"{column}_category"))
    return F.array_compact(F.array(*rules))


def add_violations(df: DataFrame) -> DataFrame:
    """Append the violation codes and turn the numeric predictors into doubles."""
    present = {c.lower() for c in df.columns}
    missing = [c for c in D.RAW_FEATURES if c not in present]
    if missing:
        raise InvalidInput(f"missing required columns: {missing}")
    return df.withColumn("violations", violation_codes()).withColumns(
        {c: F.col(c).try_cast("double") for c in D.NUMERIC_RANGES}
    )


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and quarantined rows with their violation codes."""
    flagged = add_violations(df)
    clean = F.size("violations") == 0
    return flagged.where(clean).drop("violations"), flagged.where(~clean)


def require_valid(df: DataFrame) -> DataFrame:
    """The rows unchanged; fails, naming the codes, if any row breaks a rule."""
    broken = violation_summary(df).collect()  # a row per code
    if broken:
        raise InvalidInput(", ".join(f"{r['violation']}: {r['rows']}" for r in broken))
    return df


def violation_summary(df: DataFrame) -> DataFrame:
    """Rows per violation code."""
    return (
        add_violations(df)
        .select(F.explode("violations").alias("violation"))
        .groupBy("violation")
        .agg(F.count("*").alias("rows"))
    )


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null count and percentage per column."""
    counted = df.agg(
        F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    return unpivot_row(
        counted,
        {c: [F.col(c), F.round(F.col(c) * 100.0 / F.col("n"), 4)] for c in columns},
        ["column_name", "null_count", "null_pct"],
    )


def rows_with_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of rows with a null in any of the columns, and of all rows."""
    any_null = F.lit(False)
    for c in columns:
        any_null = any_null | F.col(c).isNull()
    return df.agg(F.count_if(any_null).alias("rows_with_null"), F.count("*").alias("total_rows"))


def column_info(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null count and type per column."""
    kinds = dict(df.dtypes)
    counted = df.agg(*[F.count(c).alias(c) for c in columns])
    return unpivot_row(
        counted,
        {c: [F.col(c), F.lit(kinds[c])] for c in columns},
        ["column_name", "non_null", "dtype"],
    )


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows after the first of equal keys (nulls equal), and how many keys repeat."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("copies"))
    return per_key.agg(
        F.sum(F.col("copies") - 1).alias("duplicate_rows"),
        F.count_if(F.col("copies") > 1).alias("repeated_keys"),
        F.sum("copies").alias("total_rows"),
    )


def repeated_ids(df: DataFrame, column: str) -> DataFrame:
    """The values of an id column that more than one row has, and how many rows; nulls are no ids.

    A first pass counts 64-bit hashes, which are short whatever the ids are, and leaves the
    suspects; only their rows are counted by the id itself, so equal hashes of different ids
    do no harm. Counts are combined before the shuffle, so one id may have any share of the rows.
    """
    ids = df.where(F.col(column).isNotNull()).select(column, F.xxhash64(column).alias("_hash"))
    suspects = ids.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1").select("_hash")
    counted = ids.join(suspects, "_hash", "left_semi").groupBy(column).agg(F.count("*").alias("copies"))
    return counted.where("copies > 1")


def range_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Failing rows per named condition with a PASS or FAIL verdict; nulls do not fail."""
    names = list(checks)
    failed = df.agg(*[F.count_if(~checks[name]).alias(name) for name in names])
    return unpivot_row(
        failed,
        {n: [F.col(n), F.when(F.col(n) == 0, "PASS").otherwise("FAIL")] for n in names},
        ["check_name", "failed_rows", "verdict"],
    )


def cardinality(df: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    """Distinct values per column, a null counting as one value.

    ``approx`` uses a fixed-size sketch for columns of unbounded cardinality.
    """

    def distinct(c: str) -> Column:
        counted = F.approx_count_distinct(c) if approx else F.count_distinct(F.col(c))
        return counted + F.max(F.col(c).isNull().cast("bigint"))

    counted = df.agg(*[distinct(c).alias(c) for c in columns])
    return unpivot_row(counted, {c: [F.col(c)] for c in columns}, ["column_name", "n_unique"])


def predictor_faults():
    """Why the design codes cannot hold a row with defaults filled in, as an array of codes."""
    distance = F.coalesce(F.col("distance_km").try_cast("double") > 0, F.lit(False))
    traffic = F.coalesce(F.col("traffic_level").isin(D.TRAFFIC_LEVELS), F.lit(False))
    return F.array_compact(
        F.array(F.when(~distance, F.lit("distance_not_positive")), F.when(~traffic, F.lit("unknown_traffic")))
    )


def training_faults(target: str = D.TARGET):
    """Why a row cannot be trained on: one rule for retraining and for its eligibility."""
    minutes = F.coalesce(F.col(target).try_cast("double") > 0, F.lit(False))
    return F.array_compact(
        F.concat(F.array(F.when(~minutes, F.lit("target_not_positive"))), predictor_faults())
    )
