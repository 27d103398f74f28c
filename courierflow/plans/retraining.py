"""One least-squares model per hotel, for all hotels in one job.

Rows are reduced to cross-product matrices per hotel and fold where they lie, so
what moves between tasks is a few hundred numbers per hotel and fold, however
many rows a hotel has. Models and scores then follow by joins on the hotel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courierflow import domain as D
from courierflow.functions.features import add_features
from courierflow.functions.rounding import np_round
from courierflow.operators.columns import impute_defaults
from courierflow.operators.metrics import regression_metrics
from courierflow.operators.quality import predictor_faults, training_faults
from courierflow.operators.splitting import with_exact_split, with_fold
from courierflow.session import written

MIN_ROWS = 10
TEST_FOLD = -1

# Order of the design columns: scaled numbers, codes, dummies, flags.
DESIGN = (
    D.FULL_NUMERIC_FEATURES
    + [f"{c}_code" for c in D.FULL_ORDINAL_FEATURES]
    + [f"{c}_{lvl.lower()}" for c in D.NOMINAL_FEATURES for lvl in sorted(D.CATEGORY_DOMAINS[c])]
    + D.BINARY_FEATURES
)
SCALED = len(D.FULL_NUMERIC_FEATURES)
WIDTH = len(DESIGN) + 2  # a constant in front, the target behind


def training_rows(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows with a positive numeric target, defaults filled in, and features added.

    Rows the ordinal codes cannot hold (no positive distance, unknown traffic
    level) are left out; an unknown weather, time or vehicle has no dummy.
    """
    filled, added = impute_defaults(df)
    usable = filled.where(F.size(training_faults()) == 0)
    return add_features(usable.withColumn(D.TARGET, F.col(D.TARGET).try_cast("double"))), added


def rejected_rows(df: DataFrame) -> DataFrame:
    """The rows ``training_rows`` leaves out, as they came, with the reasons in ``faults``."""
    given = df.withColumn("_given", F.struct("*"))
    filled, _ = impute_defaults(given)
    rejected = filled.withColumn("_faults", training_faults()).where(F.size("_faults") > 0)
    return rejected.select("_given.*", F.col("_faults").alias("faults"))


def design_columns() -> list[Column]:
    """The design as columns: constant, columns of DESIGN, target."""
    columns = [F.lit(1.0)]
    columns += [F.col(c).cast("double") for c in D.FULL_NUMERIC_FEATURES]
    for c in D.FULL_ORDINAL_FEATURES:
        levels = F.array(*[F.lit(x) for x in D.ORDINAL_DOMAINS[c]])
        code = F.array_position(levels, F.col(c)).cast("double") - 1.0
        columns.append(code)
    for c in D.NOMINAL_FEATURES:
        for level in sorted(D.CATEGORY_DOMAINS[c]):
            columns.append(F.coalesce(F.col(c) == level, F.lit(False)).cast("double"))
    columns += [F.col(c).cast("double") for c in D.BINARY_FEATURES]
    columns.append(F.col(D.TARGET).cast("double"))
    return columns


def design_array() -> Column:
    return F.array(*design_columns())


def cross_products(rows: DataFrame) -> DataFrame:
    """Cross-product matrix per hotel and fold, flattened to an array.

    One sum for each pair of columns, combined before the shuffle for hot hotels too: a
    task sends one row a hotel and fold.
    """
    design = rows.select("hotel_id", "fold", *[c.alias(f"x{i}") for i, c in enumerate(design_columns())])
    pairs = [(i, j) for i in range(WIDTH) for j in range(i, WIDTH)]
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in pairs]
    cells = [F.col(f"s{min(i, j)}_{max(i, j)}") for i in range(WIDTH) for j in range(WIDTH)]
    return design.groupBy("hotel_id", "fold").agg(*sums).select("hotel_id", "fold", F.array(*cells).alias("products"))


def least_squares(products: np.ndarray) -> np.ndarray:
    """Intercept and weights of the smallest least-squares solution.

    Numeric columns count as standardized, so the choice among equal fits is the
    one made on standardized data.
    """
    n = products[0, 0]
    means = products[0, :] / n
    centred = products / n - np.outer(means, means)
    x, y = slice(1, WIDTH - 1), WIDTH - 1
    scale = np.ones(len(DESIGN))
    scale[:SCALED] = np.sqrt(np.clip(np.diag(centred)[1 : 1 + SCALED], 0, None))
    scale[scale == 0] = 1.0
    a = centred[x, x] / np.outer(scale, scale)
    b = centred[x, y] / scale
    weights = (np.linalg.pinv(a, rcond=1e-10, hermitian=True) @ b) / scale
    return np.concatenate([[means[y] - means[x] @ weights], weights])


_MODEL_SCHEMA = T.StructType(
    [
        T.StructField("hotel_id", T.LongType()),
        T.StructField("fold", T.IntegerType()),
        T.StructField("train_mean", T.DoubleType()),
        T.StructField("weights", T.ArrayType(T.DoubleType())),
    ]
)


def _solve(part: pd.DataFrame) -> pd.DataFrame:
    """Models of one hotel: on all training folds (kept for test rows) and without each fold."""
    by_fold = {
        int(f): np.asarray(p).reshape(WIDTH, WIDTH) for f, p in zip(part["fold"], part["products"])
    }
    train = {f: p for f, p in by_fold.items() if f != TEST_FOLD}
    whole = sum(train.values())
    fits = {TEST_FOLD: whole, **{f: whole - p for f, p in train.items()}}
    rows = [
        (int(part["hotel_id"].iloc[0]), f, m[0, -1] / m[0, 0], least_squares(m).tolist())
        for f, m in fits.items()
        if m[0, 0] > 0
    ]
    return pd.DataFrame(rows, columns=["hotel_id", "fold", "train_mean", "weights"])


def placed_rows(df: DataFrame, id_column: str) -> DataFrame:
    """Usable rows of hotels with enough of them, with split and training fold.

    Test rows carry fold -1; the fold count follows the hotel's training rows.
    """
    rows, _ = training_rows(df)
    test = F.greatest(F.lit(2), F.floor(F.col("n") / 5))
    split = with_exact_split(rows, id_column, test, ["hotel_id"])
    n = F.col("group_rows")
    train_rows = n - F.greatest(F.lit(2), F.floor(n / 5))
    folds = F.least(F.lit(5), F.greatest(F.lit(2), F.floor(train_rows / 3)))
    placed = with_fold(split.where(n >= MIN_ROWS), id_column, folds)
    return placed.withColumn(
        "fold", F.when(F.col("split") == "test", F.lit(TEST_FOLD)).otherwise(F.col("fold"))
    ).drop("group_rows")


def fit_hotels(placed: DataFrame) -> DataFrame:
    """Weights per hotel and left-out fold; fold -1 is the model on all training rows.

    A group given to Python is one hotel's handful of summed matrices.
    """
    return cross_products(placed).groupBy("hotel_id").applyInPandas(_solve, _MODEL_SCHEMA)


def score_rows(placed: DataFrame, models: DataFrame) -> DataFrame:
    """Predictions for test rows by the full model and for training rows out of fold."""
    terms = F.zip_with(
        F.slice(design_array(), 1, WIDTH - 1), F.col("weights"), lambda x, w: x * w
    )
    predicted = F.aggregate(terms, F.lit(0.0), lambda total, t: total + t)
    return placed.join(models, ["hotel_id", "fold"]).select(
        "hotel_id",
        F.when(F.col("fold") == TEST_FOLD, "test").otherwise("cv").alias("role"),
        "fold",
        D.TARGET,
        predicted.alias("predicted"),
        "train_mean",
    )


def retrain_hotels(df: DataFrame, id_column: str = D.ID_COLUMN) -> tuple[DataFrame, DataFrame]:
    """Model weights and the training report of every hotel with at least ten usable rows."""
    placed = written(placed_rows(df, id_column), "retraining-rows")
    models = written(fit_hotels(placed), "hotel-models")
    scored = score_rows(placed, models)
    by_fold = regression_metrics(scored, D.TARGET, "predicted", ["hotel_id", "role", "fold"])
    baseline = regression_metrics(
        scored.where("role = 'test'"), D.TARGET, "train_mean", ["hotel_id"]
    ).select("hotel_id", F.col("mae").alias("baseline_mae"))
    is_test = F.col("role") == "test"
    report = (
        by_fold.groupBy("hotel_id")
        .agg(
            F.sum("n").alias("total_samples"),
            F.sum(F.when(~is_test, F.col("n"))).alias("train_samples"),
            F.sum(F.when(is_test, F.col("n"))).alias("test_samples"),
            *[F.max(F.when(is_test, F.col(m))).alias(f"model_{m}") for m in ("mae", "rmse", "r2")],
            F.round(F.avg(F.when(~is_test, F.col("mae"))), 4).alias("cv_mae"),
            F.count_if(~is_test).alias("folds"),
        )
        .join(baseline, "hotel_id")
    )
    gain = F.col("baseline_mae") - F.col("model_mae")
    lift = F.coalesce(F.round(F.try_divide(gain, F.col("baseline_mae")) * 100.0, 2), F.lit(0.0))
    full = models.where(F.col("fold") == TEST_FOLD).select("hotel_id", "train_mean", "weights")
    return full, report.withColumn("mae_improvement_pct", lift)


def predict_for_hotels(df: DataFrame, weights: DataFrame, default_minutes) -> DataFrame:
    """Predicted minutes by the hotel's own model, or ``default_minutes`` where it has none."""
    filled, _ = impute_defaults(df)
    design = add_features(filled.withColumn(D.TARGET, F.lit(0.0)))
    # the codes hold no other rows; those get the default
    fits = F.size(predictor_faults()) == 0
    terms = F.zip_with(
        F.slice(design_array(), 1, WIDTH - 1), F.col("weights"), lambda x, w: x * w
    )
    own = F.when(fits, np_round(F.aggregate(terms, F.lit(0.0), lambda total, t: total + t), 2))
    return (
        design.join(weights.select("hotel_id", "weights"), "hotel_id", "left")
        .withColumn("_own", own)
        .withColumn("model_used", F.when(F.col("_own").isNull(), "default").otherwise("custom"))
        .withColumn("predicted_delivery_time_min", F.coalesce("_own", default_minutes))
        .drop("_own", "weights", D.TARGET, *D.ENGINEERED_FEATURES)
    )


def model_status(hotels: DataFrame, report: DataFrame) -> DataFrame:
    """Whether each hotel has its own model, and that model's figures."""
    known = report.select("hotel_id", "total_samples", "model_mae", "mae_improvement_pct")
    return hotels.select("hotel_id").join(known, "hotel_id", "left").withColumn(
        "custom_model_available", F.col("total_samples").isNotNull()
    )
