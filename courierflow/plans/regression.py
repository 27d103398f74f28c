"""Training, evaluation, cross-validation, grid search and scoring with Spark ML pipelines."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from itertools import product

import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierflow import domain as D
from courierflow.functions.features import FEATURE_SQL, add_features
from courierflow.functions.rounding import np_round, py_round
from courierflow.functions.scalars import delay_risk
from courierflow.operators.columns import impute_defaults
from courierflow.operators.metrics import metric_columns, regression_metrics
from courierflow.operators.preparation import Preparation, fit_preparation
from courierflow.operators.quality import split_valid
from courierflow.operators.splitting import with_fold
from courierflow.plans.forests import GrownTrees, TreeRule, binned, deep_errors, grow, held_errors, rules_of, shared_rules
from courierflow.plans.subtrees import Bins, SubtreeRule, subtree_predictions, thresholds
from courierflow.session import written

PREDICTED = "predicted_delivery_time_min"
BASELINE = "mean_baseline"
SEED = 42
ROWS_PER_TASK = 25_000
UNEVEN = 1.25
ROWS_PER_SUBTREE = 20_000
SHALLOW_DEPTH = 10
ROWS_OF_SPARK_ML = 50_000

# Tree defaults grow to the engine's depth limit; tuned settings and grids.
UNLIMITED_DEPTH = 30
TUNED_TREE = {"maxDepth": 5, "minInstancesPerNode": 4}
TUNED_FOREST = {"maxDepth": 10, "minInstancesPerNode": 4, "numTrees": 100}
TREE_GRID = {"maxDepth": [3, 5, 8, UNLIMITED_DEPTH], "minInstancesPerNode": [1, 2, 4]}
FOREST_GRID = {
    "numTrees": [50, 100],
    "maxDepth": [6, 10, UNLIMITED_DEPTH],
    "minInstancesPerNode": [1, 2, 4],
}


def linear(**settings) -> LinearRegression:
    """Ordinary least squares."""
    return LinearRegression(labelCol=D.TARGET, regParam=0.0, **settings)


def tree(**settings) -> DecisionTreeRegressor:
    chosen = {"maxDepth": UNLIMITED_DEPTH, "seed": SEED, **settings}
    return DecisionTreeRegressor(labelCol=D.TARGET, **chosen)


def forest(**settings) -> RandomForestRegressor:
    """Bagged trees that see every feature at each split."""
    chosen = {
        "maxDepth": UNLIMITED_DEPTH,
        "numTrees": 100,
        "featureSubsetStrategy": "all",
        "seed": SEED,
        **settings,
    }
    return RandomForestRegressor(labelCol=D.TARGET, **chosen)


def candidate_regressors() -> dict[str, Estimator]:
    return {"linear_regression": linear(), "decision_tree": tree(), "random_forest": forest()}


def tuned_regressors() -> dict[str, Estimator]:
    return {
        "linear_regression": linear(),
        "decision_tree": tree(**TUNED_TREE),
        "random_forest": forest(**TUNED_FOREST),
    }


def fallback_minutes(km: Column) -> Column:
    """ETA where no prediction can be made."""
    return py_round(F.lit(15.0) + km * 2.5, 1)


def preparation_stages(prepared: Preparation) -> list:
    """Feature engineering and the fitted matrix as stages that save with the model."""
    stages = []
    if prepared.binary:
        engineered = ", ".join(f"{sql} as {name}" for name, sql in FEATURE_SQL.items())
        stages.append(SQLTransformer(statement=f"select *, {engineered} from __THIS__"))
    matrix = prepared.matrix_sql()
    columns = ", ".join(f"{sql} as m_{name}" for name, sql in matrix.items())
    stages.append(SQLTransformer(statement=f"select *, {columns} from __THIS__"))
    stages.append(VectorAssembler(inputCols=[f"m_{n}" for n in matrix], outputCol="features"))
    return stages


def spread(rows: DataFrame, ordered: bool = True) -> DataFrame:
    """The rows in as many even tasks as the cluster has cores, where a few large files would give fewer.

    Each pass of a fit takes as long as its largest task. Every task sums up all nodes of
    a level, so more tasks than cores would only shuffle more. The order within a task is fixed.
    """
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    wanted = min(rows.sparkSession.sparkContext.defaultParallelism, -(-sum(sizes) // ROWS_PER_TASK))
    if wanted < 2 or (len(sizes) >= wanted and max(sizes) * wanted <= UNEVEN * sum(sizes)):
        return rows
    dealt = rows.repartition(wanted, *rows.columns)
    return dealt.sortWithinPartitions(*rows.columns) if ordered else dealt


def bins_of(matrix: DataFrame, rows: int, most: int, seed: int) -> Bins:
    """Bounds of the bins of a matrix, from a sample as large as Spark ML's own."""
    wanted = max(most * most, 10_000)
    sample = matrix if rows <= wanted else matrix.sample(wanted / rows, seed=seed)
    return Bins(thresholds([r["features"].toArray() for r in sample.select("features").collect()], most))


def put_in_bins(
    matrix: DataFrame, rows: int, regressors: dict[str, Estimator]
) -> list[tuple[dict[str, Estimator], Bins, DataFrame]]:
    """Regressors with the same number of bins, their bins, and the matrix as written codes."""
    found = []
    for most in sorted({r.getMaxBins() for r in regressors.values()}):
        alike = {name: r for name, r in regressors.items() if r.getMaxBins() == most}
        bins = bins_of(matrix, rows, min(most, rows), next(iter(alike.values())).getSeed())
        found.append((alike, bins, binned(matrix, D.TARGET, bins)))
    return found


def grow_together(alike: dict[str, Estimator], bins: Bins, blocks: DataFrame) -> dict[str, GrownTrees]:
    """The trees of all regressors, grown in the same passes."""
    rules = {name: rules_of(r) for name, r in alike.items()}
    trees = iter(grow(blocks, bins, [rule for of in rules.values() for rule in of]))
    return {name: GrownTrees(alike[name], [next(trees) for _ in of], bins) for name, of in rules.items()}


def fit_models(
    train: DataFrame,
    regressors: dict[str, Estimator],
    id_column: str = D.ID_COLUMN,
    engineered: bool = True,
    parallelism: int = 4,
    saved: bool = True,
) -> dict[str, PipelineModel]:
    """Fit one preparation and all regressors on training rows.

    The regressors share one persisted matrix: fitting passes over it many times.
    Trees of many rows are grown together (``plans/forests.py``), as Spark ML's passes
    touch the sums of all nodes of all trees with each row. Every result is a whole
    pipeline, raw predictors in and minutes out; grown trees become Spark ML's models
    unless they are only to score and not to be ``saved``.
    """
    known = train.select(id_column, *D.RAW_FEATURES, D.TARGET)
    known = spread(known.where(F.col(D.TARGET).isNotNull())).persist(StorageLevel.MEMORY_AND_DISK)
    prepared = fit_preparation(add_features(known), engineered)
    stages = preparation_stages(prepared)
    matrix = PipelineModel(stages).transform(known).select("features", D.TARGET)
    matrix = matrix.persist(StorageLevel.MEMORY_AND_DISK)
    rows = known.count()
    grown = {name: r for name, r in regressors.items() if rows > ROWS_OF_SPARK_ML and rules_of(r)}
    try:
        with ThreadPoolExecutor(parallelism) as pool:
            rest = {name: pool.submit(r.fit, matrix) for name, r in regressors.items() if name not in grown}
            in_bins = put_in_bins(matrix, rows, grown)
            models = {name: fit.result() for name, fit in rest.items()}
    finally:
        matrix.unpersist()
        known.unpersist()
    for alike, bins, blocks in in_bins:
        trees = grow_together(alike, bins, blocks)
        models |= {name: t.spark_model(train.sparkSession) if saved else t for name, t in trees.items()}
    return {name: PipelineModel([*stages, models[name]]) for name in regressors}


def fit_model(
    train: DataFrame, regressor: Estimator, id_column: str = D.ID_COLUMN, engineered: bool = True
) -> PipelineModel:
    return fit_models(train, {"model": regressor}, id_column, engineered)["model"]


def predict(df: DataFrame, model: PipelineModel) -> DataFrame:
    """The input columns and the predicted minutes, 2 decimals."""
    return model.transform(df).select(*df.columns, np_round(F.col("prediction"), 2).alias(PREDICTED))


def guesses(df: DataFrame, models: dict[str, PipelineModel | None], mean: Column) -> DataFrame:
    """Each row once for every model, with its name and prediction; a model of None predicts the mean.

    The predictions of all models sit side by side first, so the rows are read once.
    """
    scored = df
    for name, model in models.items():
        if model is None:
            scored = scored.withColumn(f"p_{name}", mean)
        else:
            kept = scored.columns
            scored = model.transform(scored).select(*kept, F.col("prediction").alias(f"p_{name}"))
    pairs = [F.struct(F.lit(n).alias("model"), F.col(f"p_{n}").alias("prediction")) for n in models]
    return scored.select(*df.columns, F.inline(F.array(*pairs)))


def evaluate_models(df: DataFrame, models: dict[str, PipelineModel | None]) -> DataFrame:
    """Metrics by model and split; a model of None is the training-mean baseline."""
    mean = df.where("split = 'train'").agg(F.avg(D.TARGET)).scalar()
    rows = spread(df.select("split", *D.RAW_FEATURES, D.TARGET), ordered=False)
    return regression_metrics(guesses(rows, models, mean), D.TARGET, "prediction", ["model", "split"])


def train_and_evaluate(df: DataFrame, regressors: dict[str, Estimator]) -> DataFrame:
    """Fit every regressor on the train split and report all metrics with the baseline."""
    models = fit_models(df.where("split = 'train'"), regressors, saved=False)
    return evaluate_models(df, {BASELINE: None, **models})


def cross_validate(
    train: DataFrame,
    regressors: dict[str, Estimator | None],
    id_column: str = D.ID_COLUMN,
    folds: int = 5,
    parallelism: int = 4,
) -> DataFrame:
    """Metrics by model and fold; preparation is fitted anew without the fold's rows.

    A regressor of None predicts the mean of the other folds. The folds are a written
    table, so nothing stays in memory once the result is planned. All folds run at once,
    so that none is left to run by itself.
    """
    placed = written(spread(with_fold(train, id_column, folds, SEED)), "folds")
    fitted = {name: r for name, r in regressors.items() if r is not None}

    def one(fold: int) -> DataFrame:
        others = placed.where(F.col("fold") != fold)
        models = fit_models(others, fitted, id_column, parallelism=parallelism, saved=False)
        held_out = placed.where(F.col("fold") == fold).select("fold", *D.RAW_FEATURES, D.TARGET)
        mean = others.agg(F.avg(D.TARGET)).scalar()
        return guesses(held_out, {name: models.get(name) for name in regressors}, mean)

    with ThreadPoolExecutor(folds) as pool:
        parts = list(pool.map(one, range(folds)))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return regression_metrics(stacked, D.TARGET, "prediction", ["model", "fold"])


def predict_raw(df: DataFrame, model: PipelineModel) -> DataFrame:
    return model.transform(df).select(*df.columns, "prediction")


def top_depth(rows: int) -> int:
    """Levels after which the leaves of an even tree hold ``ROWS_PER_SUBTREE`` rows."""
    return max(0, -(-rows // ROWS_PER_SUBTREE) - 1).bit_length()


def grows_deep(regressor: Estimator, top: int) -> bool:
    """Whether a regressor is one plain tree that goes on well below its top levels."""
    plain = isinstance(regressor, DecisionTreeRegressor) and not regressor.isDefined("weightCol")
    return plain and not regressor.getMinWeightFractionPerNode() and regressor.getMaxDepth() > max(top, SHALLOW_DEPTH)


def deep_predictions(fit_matrix: DataFrame, held: DataFrame, trees: dict[int, DecisionTreeRegressor], top: int) -> DataFrame:
    """i, target and prediction of the held rows by fully grown trees.

    Spark ML grows the ``top`` levels. Level by level, the levels below need sums over
    every bin of every node, from every task; so each leaf of a top is handed with
    its rows to one task, which grows it on by the rules of Spark ML's tree.
    """
    rows = fit_matrix.withColumn("held", F.lit(False)).unionByName(held.withColumn("held", F.lit(True)))
    n = fit_matrix.count()
    rules, stacked = {}, None
    for i, tree_i in trees.items():
        bins = min(tree_i.getMaxBins(), n)
        if bins not in rules:
            rules[bins] = bins_of(fit_matrix, n, bins, tree_i.getSeed())
        upper = tree_i.copy({tree_i.maxDepth: top, tree_i.leafCol: "leaf"}).fit(fit_matrix)
        part = upper.transform(rows).select(
            F.lit(i).alias("i"), F.col("leaf").cast("int").alias("leaf"), "held",
            F.col(D.TARGET).cast("double").alias("y"), vector_to_array("features").alias("x"),
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    per_tree = {
        i: (rules[min(t.getMaxBins(), n)], SubtreeRule(t.getMaxDepth() - top, t.getMinInstancesPerNode(), t.getMinInfoGain()))
        for i, t in trees.items()
    }

    def grow_leaf(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return subtree_predictions(int(key[0]), group, *per_tree[int(key[0])])

    return stacked.groupBy("i", "leaf").applyInPandas(grow_leaf, "i int, y double, p double")


def errors_by_codes(
    fit_matrix: DataFrame, held: DataFrame, rows: int, made: dict[int, Estimator], deep: dict[int, Estimator], top: int
) -> dict[int, float]:
    """Mean absolute error on the held rows of every setting, whose trees all have the same number of bins.

    Settings that differ by depth are read off one tree, and deep trees go on below a top of it.
    """
    first = next(iter(made.values()))
    bins = bins_of(fit_matrix, rows, min(first.getMaxBins(), rows), first.getSeed())
    fit_blocks, held_blocks = binned(fit_matrix, D.TARGET, bins), binned(held, D.TARGET, bins)
    limits = {i: (r.getMinInstancesPerNode(), r.getMinInfoGain()) for i, r in deep.items()}
    wanted = {i: [TreeRule(top, *limits[i])] if i in deep else rules_of(r) for i, r in made.items()}
    shared = shared_rules(wanted)
    whole = dict(zip(shared, grow(fit_blocks, bins, list(shared.values()))))
    trees = {i: [whole[replace(rule, depth=0)].cut_to(rule.depth) for rule in rules] for i, rules in wanted.items()}
    parts = held_errors(held_blocks, bins, {i: of for i, of in trees.items() if i not in deep})
    if deep:
        below = {i: SubtreeRule(r.getMaxDepth() - top, *limits[i]) for i, r in deep.items()}
        parts = parts.unionByName(deep_errors(fit_blocks, held_blocks, bins, {i: trees[i][0] for i in deep}, below))
    found = parts.groupBy("i").agg(F.sum("lost").alias("lost"), F.sum("n").alias("n")).collect()
    return {r["i"]: round(r["lost"] / r["n"], 4) for r in found}


def grid_search(
    train: DataFrame,
    make: Callable[..., Estimator],
    grid: dict[str, list],
    id_column: str = D.ID_COLUMN,
    folds: int = 5,
    parallelism: int = 4,
) -> DataFrame:
    """Cross-validated MAE of every setting, best first by ``rank``.

    Each fold prepares its matrix once, fits all settings on it, and scores them
    together in one pass over the held-out rows; deep trees are grown by leaves.
    All folds run at once, since the passes of a small tree leave cores idle.
    Beyond ``ROWS_OF_SPARK_ML`` rows all trees are grown and scored by bin codes.
    """
    settings = [dict(zip(grid, values)) for values in product(*grid.values())]
    needed = ["fold", *D.RAW_FEATURES, D.TARGET]
    placed = spread(with_fold(train, id_column, folds, SEED).select(needed)).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {r["fold"]: r["count"] for r in placed.groupBy("fold").count().collect()}
    count = sum(sizes.values())
    top = top_depth(count)
    made = {i: make(**s, predictionCol=f"p{i}") for i, s in enumerate(settings)}
    deep = {i: r for i, r in made.items() if grows_deep(r, top)}
    whole = [i for i in made if i not in deep]
    by_codes = count > ROWS_OF_SPARK_ML and all(i in deep or rules_of(r) for i, r in made.items())
    by_codes = by_codes and len({r.getMaxBins() for r in made.values()}) == 1

    def score(fold: int) -> list[float]:
        fit_rows = placed.where(F.col("fold") != fold)
        matrix = PipelineModel(preparation_stages(fit_preparation(add_features(fit_rows))))
        fit_matrix = matrix.transform(fit_rows).select("features", D.TARGET)
        held = matrix.transform(placed.where(F.col("fold") == fold)).select("features", D.TARGET)
        if by_codes:
            maes = errors_by_codes(fit_matrix, held, count - sizes.get(fold, 0), made, deep, top)
            return [maes.get(i) for i in range(len(settings))]
        fit_matrix = fit_matrix.persist(StorageLevel.MEMORY_AND_DISK)
        with ThreadPoolExecutor(parallelism) as pool:
            models = list(pool.map(lambda i: made[i].fit(fit_matrix), whole))
        scored = held
        for model in models:
            scored = model.transform(scored)
        maes = {}
        if whole:
            mae = {i: metric_columns(F.col(D.TARGET), F.col(f"p{i}"))["mae"].alias(f"p{i}") for i in whole}
            maes |= dict(zip(whole, scored.agg(*mae.values()).first()))
        if deep:
            guessed = deep_predictions(fit_matrix, held, deep, top)
            found = guessed.groupBy("i").agg(metric_columns(F.col("y"), F.col("p"))["mae"].alias("mae")).collect()
            maes |= {r["i"]: r["mae"] for r in found}
        fit_matrix.unpersist()
        return [maes.get(i) for i in range(len(settings))]

    with ThreadPoolExecutor(folds) as pool:
        scores = list(pool.map(score, range(folds)))
    placed.unpersist()
    means = [sum(fold[i] for fold in scores) / folds for i in range(len(settings))]
    ranked = sorted(range(len(settings)), key=lambda i: (means[i], i))
    names = list(grid)
    rows = [
        (*[settings[i][n] for n in names], round(means[i], 4), rank)
        for rank, i in enumerate(ranked, start=1)
    ]
    schema = ", ".join(f"{n} int" for n in names) + ", cv_mae double, rank int"
    return train.sparkSession.createDataFrame(rows, schema)


def score_batch(df: DataFrame, model: PipelineModel) -> tuple[DataFrame, DataFrame]:
    """Scored rows with their risk, and quarantined rows with the rules they break.

    Absent predictors and empty cells get the operational defaults first.
    """
    filled, _ = impute_defaults(df)
    valid, broken = split_valid(filled)
    scored = predict(valid, model).withColumn("risk_status", delay_risk(F.col(PREDICTED)))
    return scored, broken
