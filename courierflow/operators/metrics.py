"""Regression metrics and evaluation reports, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from courierflow import domain as D
from courierflow.functions.rounding import py_round
from courierflow.operators.columns import impute_defaults
from courierflow.operators.profiling import as_levels
from courierflow.operators.quality import training_faults
from courierflow.operators.splitting import with_fold

METRICS = ("mae", "mse", "rmse", "r2")

# Duration tiers, closed on the right; longer deliveries have none.
TIER_BOUNDS = [
    (35, "Fast (<35 min)"),
    (70, "Typical (35-70)"),
    (150, "Prolonged (>70)"),
]

# Stability labels by the deviation of the folds' MAE.
STABLE_BELOW = 0.5
MODERATE_BELOW = 0.8
CLOSE_MINUTES = 7.0


def metric_columns(actual: Column, predicted: Column) -> dict[str, Column]:
    """MAE, MSE, RMSE and R2 (against the evaluated rows' own mean), 4 decimals."""
    actual = actual.cast("double")
    error = actual - predicted
    squared = F.sum(error * error)
    spread = F.var_pop(actual) * F.count(actual)
    return {
        "mae": py_round(F.avg(F.abs(error)), 4),
        "mse": py_round(F.avg(error * error), 4),
        "rmse": py_round(F.sqrt(F.avg(error * error)), 4),
        "r2": py_round(F.lit(1.0) - F.try_divide(squared, spread), 4),
    }


def regression_metrics(
    df: DataFrame, actual: str, predicted: str, by: list[str] | None = None
) -> DataFrame:
    """Row count and metrics of each group, in one pass."""
    columns = metric_columns(F.col(actual), F.col(predicted))
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), *[c.alias(name) for name, c in columns.items()]
    )


def mean_baseline(df: DataFrame, target: str) -> DataFrame:
    """Metrics on test rows of always predicting the training mean."""
    mean = df.where("split = 'train'").agg(F.avg(target)).scalar()
    test = df.where("split = 'test'").select(F.col(target).alias("y"), mean.alias("p"))
    sizes = df.agg(F.struct(F.count_if(F.col("split") == "train").alias("train_rows"))).scalar()
    return regression_metrics(test, "y", "p").select(
        F.round(mean, 6).alias("baseline_value"),
        sizes["train_rows"].alias("train_rows"),
        F.col("n").alias("test_rows"),
        *METRICS,
    )


def baseline_preview(df: DataFrame, target: str) -> DataFrame:
    """Test rows with the baseline prediction, absolute error and its direction."""
    mean = df.where("split = 'train'").agg(F.avg(target)).scalar()
    return df.where("split = 'test'").select(
        D.ID_COLUMN,
        F.col(target).alias("actual"),
        F.round(mean, 4).alias("predicted"),
        F.round(F.abs(F.col(target) - mean), 4).alias("abs_error"),
        F.when(mean > F.col(target), "Overestimate").otherwise("Underestimate").alias("direction"),
    )


def duration_tier(minutes: Column) -> Column:
    tier = F.when(minutes <= 0, F.lit(None))
    for bound, label in TIER_BOUNDS:
        tier = tier.when(minutes <= bound, label)
    return tier


def slice_errors(df: DataFrame, actual: str, predicted: list[str]) -> DataFrame:
    """Rows and MAE of each prediction by distance, weather, traffic, severity and duration.

    Rows without a level are left out of that dimension.
    """
    dims = ["distance_category", "weather", "traffic_level", "severe_conditions", "duration_tier"]
    errors = {f"_{p}": F.abs(F.col(actual) - F.col(p)) for p in predicted}
    sliced = df.withColumns({"duration_tier": duration_tier(F.col(actual)), **errors})
    return (
        as_levels(sliced, dims, list(errors))
        .where("level is not null")
        .groupBy("dim", "level")
        .agg(
            F.count("*").alias("n"),
            *[F.round(F.avg(f"_{p}"), 4).alias(f"mae_{p}") for p in predicted],
        )
    )


def residual_profile(df: DataFrame, actual: str, predicted: str, by: list[str]) -> DataFrame:
    """Mean and absolute residual, share within 7 minutes, and the over/under split."""
    residual = F.col(actual) - F.col(predicted)
    return df.groupBy(*by).agg(
        F.round(F.avg(residual), 4).alias("mean_residual"),
        F.round(F.avg(F.abs(residual)), 4).alias("mean_abs_residual"),
        F.round(F.avg((F.abs(residual) <= CLOSE_MINUTES).cast("int")), 4).alias("share_within_7"),
        F.count_if(residual < 0).alias("overestimated"),
        F.count_if(residual >= 0).alias("underestimated"),
    )


def baseline_folds(
    df: DataFrame, id_column: str, target: str, folds: int = 5, seed: int = 42
) -> DataFrame:
    """Per-fold metrics of predicting the mean of the other folds.

    The means come from one row of sums per fold, held as a map.
    """
    placed = with_fold(df.select(id_column, F.col(target).alias("y")), id_column, folds, seed)
    sums = placed.groupBy("fold").agg(F.sum("y").alias("s"), F.count("y").alias("c"))
    per_fold = sums.agg(
        F.map_from_entries(F.collect_list(F.struct("fold", F.struct("s", "c")))).alias("m"),
    ).scalar()
    total = placed.agg(F.struct(F.sum("y").alias("s"), F.count("y").alias("c"))).scalar()
    own = per_fold[F.col("fold")]
    mean = (total["s"] - own["s"]) / (total["c"] - own["c"])
    return regression_metrics(placed.withColumn("p", mean), "y", "p", ["fold"])


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of the folds' metrics and a stability label, per model."""
    stats = []
    for m in ("mae", "rmse", "r2"):
        stats.append(F.round(F.avg(m), 4).alias(f"cv_{m}"))
        stats.append(F.round(F.stddev_pop(m), 4).alias(f"cv_{m}_std"))
    spread = F.col("cv_mae_std")
    label = (
        F.when(spread < STABLE_BELOW, "Highly Stable")
        .when(spread < MODERATE_BELOW, "Moderate Stability")
        .otherwise("High Variance / Unstable")
    )
    return folds.groupBy("model").agg(*stats).withColumn("stability", label)


def fold_matrix(folds: DataFrame, count: int = 5) -> DataFrame:
    """One row per model with the MAE and R2 of every fold in columns."""
    wide = (
        folds.groupBy("model")
        .pivot("fold", list(range(count)))
        .agg(F.first("mae").alias("mae"), F.first("r2").alias("r2"))
    )
    return wide.select(
        "model",
        *[F.col(f"{i}_{m}").alias(f"{m}_fold_{i + 1}") for m in ("mae", "r2") for i in range(count)],
    )


def lift_over_baseline(metrics: DataFrame, baseline: str) -> DataFrame:
    """Absolute and relative MAE and RMSE gain of every model over the baseline model."""
    base = (
        metrics.where(F.col("model") == baseline)
        .agg(F.struct(F.first("mae").alias("mae"), F.first("rmse").alias("rmse")))
        .scalar()
    )
    gains = {}
    for m in ("mae", "rmse"):
        gain = base[m] - F.col(m)
        gains[f"{m}_reduction"] = F.round(gain, 4)
        gains[f"{m}_lift_pct"] = F.coalesce(
            F.round(F.try_divide(gain, base[m]) * 100.0, 2), F.lit(0.0)
        )
    return metrics.select("model", "mae", "rmse", *[c.alias(n) for n, c in gains.items()])


def generalization_gap(metrics: DataFrame) -> DataFrame:
    """Test minus train of every metric, per model, from metrics by (model, split)."""
    wide = (
        metrics.groupBy("model")
        .pivot("split", ["train", "test"])
        .agg(*[F.first(m).alias(m) for m in ("mae", "rmse", "r2")])
    )
    return wide.select(
        "model",
        *[
            F.round(F.col(f"test_{m}") - F.col(f"train_{m}"), 4).alias(f"{m}_gap")
            for m in ("mae", "rmse", "r2")
        ],
    )


def model_ranks(metrics: DataFrame) -> DataFrame:
    """Rank of every model by each metric, 1 being best; the winner has rank 1."""
    better_low = metrics.select(
        "model", "mae", "rmse", F.negative(F.col("r2")).alias("r2")
    ).unpivot(["model"], ["mae", "rmse", "r2"], "criterion", "value")
    by_value = Window.partitionBy("criterion").orderBy("value")
    value = F.when(F.col("criterion") == "r2", -F.col("value")).otherwise(F.col("value"))
    return better_low.select(
        "criterion", "model", value.alias("score"), F.rank().over(by_value).alias("rank")
    )


def retrain_eligibility(df: DataFrame, target: str) -> DataFrame:
    """Per hotel: valid training rows, split sizes, folds, and whether there are enough."""
    filled, _ = impute_defaults(df)
    usable = F.size(training_faults(target)) == 0
    counted = filled.groupBy("hotel_id").agg(F.count_if(usable).alias("valid_rows"))
    n = F.col("valid_rows")
    test = F.greatest(F.lit(2), F.floor(n / 5))
    test = F.when(test >= n, F.lit(1)).otherwise(test).cast("bigint")
    train = F.greatest(F.lit(0), n - test)
    folds = F.least(F.lit(5), F.greatest(F.lit(2), F.floor(train / 3))).cast("bigint")
    eligible = n >= 10
    return counted.select(
        "hotel_id",
        "valid_rows",
        eligible.alias("eligible"),
        F.when(eligible, test).alias("test_rows"),
        F.when(eligible, train).alias("train_rows"),
        F.when(eligible, folds).alias("folds"),
    )
