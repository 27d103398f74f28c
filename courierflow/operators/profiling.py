"""Distribution reports.

Exact quantiles keep one counter per distinct value. The profiled columns lie on
fixed grids (minutes, hundredths of a kilometre), so the counters stay small
whatever the row count; pass ``exact=False`` for columns without such a grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from courierflow.operators.quality import unpivot_row


def quantiles(column: str | Column, points: list[float], exact: bool = True) -> Column:
    """Array of quantiles: linear interpolation if exact, else a bounded sketch."""
    at = F.array(*[F.lit(p) for p in points])
    return F.percentile(column, at) if exact else F.percentile_approx(column, at, 10000)


def as_levels(df: DataFrame, dims: list[str], keep: list[str | Column]) -> DataFrame:
    """One row per input row and dimension: (dim, level) and the kept columns."""
    pairs = [F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("level")) for d in dims]
    return df.select(F.inline(F.array(*pairs)), *keep)


def describe_numeric(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Count, mean, sample std, min, quartiles and max per column, in one pass."""
    aggregates = []
    for c in columns:
        aggregates.append(
            F.struct(
                F.count(c).alias("n"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("low"),
                quantiles(c, [0.25, 0.5, 0.75], exact).alias("q"),
                F.max(c).cast("double").alias("high"),
            ).alias(c)
        )
    entries = {
        c: [
            F.col(f"{c}.n"),
            F.round(F.col(f"{c}.mean"), 6),
            F.round(F.col(f"{c}.std"), 6),
            F.col(f"{c}.low"),
            *[F.round(F.col(f"{c}.q")[i].cast("double"), 6) for i in range(3)],
            F.col(f"{c}.high"),
        ]
        for c in columns
    }
    names = ["column_name", "n", "mean", "std", "min", "q25", "median", "q75", "max"]
    return unpivot_row(df.agg(*aggregates), entries, names)


def category_frequency(df: DataFrame, dims: list[str]) -> DataFrame:
    """Rows and percentage per level, null being a level."""
    counted = as_levels(df, dims, []).groupBy("dim", "level").agg(F.count("*").alias("n"))
    # The window runs over a handful of counted levels per dimension.
    total = F.sum("n").over(Window.partitionBy("dim"))
    return counted.withColumn("pct", F.round(F.col("n") * 100.0 / total, 4))


def group_profile(df: DataFrame, dims: list[str], target: str, exact: bool = True) -> DataFrame:
    """Target count, mean, median, sample std, min and max per level of each dimension."""
    median = quantiles("t", [0.5], exact)[0]
    return (
        as_levels(df, dims, [F.col(target).alias("t")])
        .groupBy("dim", "level")
        .agg(
            F.count("t").alias("n"),
            F.round(F.avg("t"), 4).alias("mean"),
            F.round(median.cast("double"), 4).alias("median"),
            F.round(F.stddev_samp("t"), 4).alias("std"),
            F.min("t").cast("double").alias("min"),
            F.max("t").cast("double").alias("max"),
        )
    )


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every ordered pair, over rows where both are given."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = []
    for a, b in pairs:
        value = F.round(F.col(f"`{a}|{b}`"), 6).alias("r")
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), value))
    return row.select(F.inline(F.array(*cells)))


def iqr_fences(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """One row: per column a struct of quartiles and the 1.5 IQR fences."""
    quartiles = df.agg(*[quantiles(c, [0.25, 0.75], exact).alias(c) for c in columns])
    fenced = []
    for c in columns:
        q1, q3 = F.col(c)[0].cast("double"), F.col(c)[1].cast("double")
        iqr = q3 - q1
        fenced.append(
            F.struct(
                q1.alias("q1"),
                q3.alias("q3"),
                iqr.alias("iqr"),
                (q1 - iqr * 1.5).alias("low"),
                (q3 + iqr * 1.5).alias("high"),
            ).alias(c)
        )
    return quartiles.select(F.struct(*fenced).alias("fences"))


def outlier_summary(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Quartiles, fences and the rows outside them, per column."""
    fences = iqr_fences(df, columns, exact).scalar()
    counts = []
    for c in columns:
        outside = (F.col(c) < fences[c]["low"]) | (F.col(c) > fences[c]["high"])
        counts.append(F.count_if(outside).alias(c))
    counted = df.agg(F.count("*").alias("n"), F.first(fences).alias("fences"), *counts)
    entries = {
        c: [
            *[F.round(F.col(f"fences.{c}.{p}"), 4) for p in ("q1", "q3", "iqr", "low", "high")],
            F.col(c),
            F.round(F.col(c) * 100.0 / F.col("n"), 4),
        ]
        for c in columns
    }
    names = ["column_name", "q1", "q3", "iqr", "low_fence", "high_fence", "outliers", "outlier_pct"]
    return unpivot_row(counted, entries, names)


def outlier_rows(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """Rows above the upper fence of the column."""
    fences = iqr_fences(df, [column], exact).scalar()
    return df.where(F.col(column) > fences[column]["high"])


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Rows per equal-width bin between the minimum and the maximum."""
    bounds = df.agg(
        F.struct(
            F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high")
        )
    ).scalar()
    low, width = bounds["low"], (bounds["high"] - bounds["low"]) / float(bins)
    number = F.least(
        F.lit(bins - 1), F.floor((F.col(column).cast("double") - low) / width).cast("int")
    )
    return (
        df.where(F.col(column).isNotNull())
        .select(number.cast("bigint").alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
        .select(
            "bin",
            F.round(low + F.col("bin") * width, 6).alias("bin_low"),
            F.round(low + (F.col("bin") + 1) * width, 6).alias("bin_high"),
            "n",
        )
    )


def five_numbers(df: DataFrame, dims: list[str], target: str, exact: bool = True) -> DataFrame:
    """Minimum, quartiles and maximum of the target per level."""
    spread = (
        as_levels(df, dims, [F.col(target).alias("t")])
        .groupBy("dim", "level")
        .agg(quantiles("t", [0.0, 0.25, 0.5, 0.75, 1.0], exact).alias("q"))
    )
    named = ["min", "q25", "median", "q75", "max"]
    return spread.select(
        "dim",
        "level",
        *[F.round(F.col("q")[i].cast("double"), 4).alias(n) for i, n in enumerate(named)],
    )


def linear_trend(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """Least-squares slope, intercept and R2 of the target on each column alone."""
    row = df.agg(
        *[
            F.struct(
                F.regr_slope(target, c).alias("slope"),
                F.regr_intercept(target, c).alias("intercept"),
                F.regr_r2(target, c).alias("r2"),
            ).alias(c)
            for c in columns
        ]
    )
    entries = {
        c: [F.round(F.col(f"{c}.{p}"), 6) for p in ("slope", "intercept", "r2")] for c in columns
    }
    return unpivot_row(row, entries, ["column_name", "slope", "intercept", "r2"])


def _bias_corrected_skew(column: str) -> Column:
    n = F.count(column).cast("double")
    return F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2)


def split_comparison(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """Train and test statistics side by side, with difference and percentage of train."""
    per_split = df.groupBy("split").agg(
        F.count(column).cast("double").alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        quantiles(column, [0.25, 0.5, 0.75], exact).alias("q"),
        F.min(column).cast("double").alias("min"),
        F.max(column).cast("double").alias("max"),
        _bias_corrected_skew(column).alias("skew"),
    )
    q25, q50, q75 = (F.col("q")[i].cast("double") for i in range(3))
    stats = {
        "count": F.col("count"),
        "mean": F.col("mean"),
        "std": F.col("std"),
        "median": q50,
        "iqr": q75 - q25,
        "min": F.col("min"),
        "q25": q25,
        "q75": q75,
        "max": F.col("max"),
        "skew": F.col("skew"),
    }
    rows = [F.struct(F.lit(k).alias("stat"), v.alias("value")) for k, v in stats.items()]
    sided = (
        per_split.select("split", F.inline(F.array(*rows)))
        .groupBy("stat")
        .pivot("split", ["train", "test"])
        .agg(F.first("value"))
    )
    gap = F.abs(F.col("train") - F.col("test"))
    return sided.select(
        "stat",
        F.round("train", 4).alias("train"),
        F.round("test", 4).alias("test"),
        F.round(gap, 4).alias("abs_diff"),
        F.round(gap * 100.0 / F.nullif(F.col("train"), F.lit(0.0)), 4).alias("pct_of_train"),
    )


def _split_counts(df: DataFrame, dims: list[str]) -> DataFrame:
    return (
        as_levels(df, dims, ["split"])
        .groupBy("dim", "level")
        .agg(
            F.count_if(F.col("split") == "train").alias("train_rows"),
            F.count_if(F.col("split") == "test").alias("test_rows"),
        )
    )


def level_coverage(df: DataFrame, dims: list[str]) -> DataFrame:
    """For each level whether it occurs in train, in test, or only in one of them."""
    train, test = F.col("train_rows") > 0, F.col("test_rows") > 0
    return _split_counts(df, dims).select(
        "dim",
        "level",
        train.alias("in_train"),
        test.alias("in_test"),
        F.when(train & test, "both").when(train, "train_only").otherwise("test_only").alias("seen"),
    )


def split_proportions(df: DataFrame, dims: list[str]) -> DataFrame:
    """Percentage of each level within each split, one row per level and split."""
    counted = _split_counts(df, dims)
    whole = Window.partitionBy("dim")
    shares = counted.select(
        "dim",
        "level",
        F.round(F.col("train_rows") * 100.0 / F.sum("train_rows").over(whole), 4).alias("train"),
        F.round(F.col("test_rows") * 100.0 / F.sum("test_rows").over(whole), 4).alias("test"),
    )
    return shares.unpivot(["dim", "level"], ["train", "test"], "split", "pct")


def leakage_audit(df: DataFrame, id_column: str, target: str, features: list[str]) -> DataFrame:
    """Named checks on a split table: disjoint ids, whole row count, clean feature list."""
    per_id = df.groupBy(id_column).agg(
        F.count("*").alias("copies"),
        (F.min("split") != F.max("split")).alias("shared"),
    )
    facts = per_id.agg(
        F.count_if("shared").alias("shared_ids"),
        F.sum("copies").alias("rows"),
        F.count("*").alias("ids"),
    )
    lowered = {f.lower() for f in features}
    entries = {
        "splits_share_no_id": [F.col("shared_ids") == 0],
        "every_id_once": [F.col("rows") == F.col("ids")],
        "target_not_in_features": [F.lit(target.lower() not in lowered)],
        "id_not_in_features": [F.lit(id_column.lower() not in lowered)],
        "twelve_features": [F.lit(len(lowered) == 12)],
    }
    return unpivot_row(facts, entries, ["check_name", "passed"])


def feature_signal(df: DataFrame, flags: list[str], target: str) -> DataFrame:
    """Target mean per flag value and the flag's correlation with the target."""
    r = df.agg(F.struct(*[F.corr(f, target).alias(f) for f in flags])).scalar()
    per_level = (
        as_levels(df, flags, [F.col(target).alias("t")])
        .groupBy("dim", "level")
        .agg(
            F.count("t").alias("n"),
            F.round(F.avg("t"), 4).alias("mean"),
            F.round(F.stddev_samp("t"), 4).alias("std"),
        )
    )
    picked = F.coalesce(*[F.when(F.col("dim") == f, r[f]) for f in flags])
    return per_level.withColumn("corr_with_target", F.round(picked, 6))
