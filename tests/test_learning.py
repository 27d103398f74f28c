from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from courierflow import domain as D
from courierflow.operators import splitting
from courierflow.operators.preparation import fit_preparation
from courierflow.functions.features import add_features
from courierflow.plans import forests, regression, retraining, subtrees
from courierflow.session import work_path
from courierflow.sources import registry


@pytest.fixture(scope="module")
def rows(tables):
    return splitting.with_split(tables.deliveries)


@pytest.fixture(scope="module")
def model(rows):
    return regression.fit_model(rows.where("split = 'train'"), regression.linear())


def test_linear_predictions_are_least_squares(rows, model):
    featured = add_features(rows)
    train = featured.where("split = 'train'")
    prepared = fit_preparation(train)

    def design(df):
        table = prepared.matrix(df, "order_id", D.TARGET).toPandas().sort_values("order_id")
        x = table.drop(columns=["order_id", D.TARGET]).to_numpy(dtype=float)
        return np.c_[np.ones(len(x)), x], table[D.TARGET].to_numpy(dtype=float)

    x, y = design(train)
    weights = np.linalg.lstsq(x, y, rcond=None)[0]
    test = rows.where("split = 'test'")
    want = design(add_features(test))[0] @ weights
    got = regression.predict_raw(test, model).orderBy("order_id").toPandas()["prediction"].to_numpy()
    assert np.abs(got - want).max() < 1e-3


def test_linear_beats_the_mean_by_far(rows, model):
    report = regression.evaluate_models(rows, {regression.BASELINE: None, "linear": model}).collect()
    mae = {(r["model"], r["split"]): r["mae"] for r in report}
    assert mae["linear", "test"] < 0.6 * mae[regression.BASELINE, "test"]


def test_prediction_is_rounded_and_model_reloads(spark, rows, model):
    path = work_path(spark, "test-model")
    registry.save_model(model, path)
    again = registry.load_model(path)
    test = rows.where("split = 'test'")
    first = regression.predict(test, model).orderBy("order_id").toPandas()
    second = regression.predict(test, again).orderBy("order_id").toPandas()
    assert (first[regression.PREDICTED] == second[regression.PREDICTED]).all()
    assert np.isfinite(first[regression.PREDICTED]).all()
    assert np.allclose(first[regression.PREDICTED] * 100, np.rint(first[regression.PREDICTED] * 100))


def test_batch_scoring_fills_gaps_and_quarantines(spark, model):
    df = spark.createDataFrame(
        [(1, 5.0, "Clear"), (2, -1.0, "Clear"), (3, None, None), (4, 4.0, "Tornado")],
        "order_id bigint, distance_km double, weather string",
    )
    scored, broken = regression.score_batch(df, model)
    assert sorted(r["order_id"] for r in scored.collect()) == [1, 3]
    assert {r["order_id"]: r["violations"] for r in broken.collect()} == {
        2: ["distance_km_range"], 4: ["weather_category"],
    }


def test_cross_validation_of_a_forest_and_the_mean(rows):
    train = rows.where("split = 'train'")
    models = {"forest": regression.forest(maxDepth=4, numTrees=5), regression.BASELINE: None}
    found = {(r["model"], r["fold"]): r for r in regression.cross_validate(train, models, folds=2).collect()}
    placed = splitting.with_fold(train, D.ID_COLUMN, 2).toPandas()
    for fold in (0, 1):
        held, others = (placed[(placed["fold"] == fold) == own][D.TARGET] for own in (True, False))
        base = found[regression.BASELINE, fold]
        assert base["n"] == len(held) and abs(base["mae"] - (held - others.mean()).abs().mean()) < 1e-4
        assert found["forest", fold]["mae"] < 0.8 * base["mae"]


def test_cross_validation_and_grid(rows):
    train = rows.where("split = 'train'")
    folds = regression.cross_validate(train, {"linear": regression.linear()}, folds=3)
    assert [r["fold"] for r in folds.orderBy("fold").collect()] == [0, 1, 2]
    grid = regression.grid_search(train, regression.tree, {"maxDepth": [2, 5], "minInstancesPerNode": [4]}, folds=2)
    best = grid.where("rank = 1").first()
    assert best["maxDepth"] == 5


def test_hotel_models_equal_direct_least_squares(tables):
    placed = retraining.placed_rows(tables.deliveries, "order_id").cache()
    models = {(r["hotel_id"], r["fold"]): np.array(r["weights"]) for r in retraining.fit_hotels(placed).collect()}
    hotel = placed.groupBy("hotel_id").count().orderBy(F.desc("count")).first()["hotel_id"]
    table = placed.where(F.col("hotel_id") == hotel).select(
        "fold", retraining.design_array().alias("x")
    ).toPandas()
    x = np.vstack(table["x"].to_numpy())
    train = (table["fold"] != retraining.TEST_FOLD).to_numpy()
    weights = np.linalg.lstsq(x[train, :-1], x[train, -1], rcond=None)[0]
    assert np.allclose(
        x[train, :-1] @ models[hotel, retraining.TEST_FOLD], x[train, :-1] @ weights, atol=1e-5
    )
    sizes = placed.groupBy("hotel_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")
    )
    assert sizes.where(F.col("t") != F.greatest(F.lit(2), F.floor(F.col("n") / 5))).count() == 0


def test_retraining_needs_ten_rows_and_reports_lift(tables):
    few = tables.deliveries.where("hotel_id > 2 or (hotel_id = 1 and order_id % 400 = 1)")
    weights, report = retraining.retrain_hotels(few)
    rows = report.collect()
    assert rows and all(r["total_samples"] >= 10 for r in rows)
    assert {r["hotel_id"] for r in weights.collect()} == {r["hotel_id"] for r in rows}
    better = [r for r in rows if r["model_mae"] < r["baseline_mae"]]
    assert len(better) > len(rows) / 2
    scored = retraining.predict_for_hotels(tables.deliveries, weights, F.lit(30.0))
    used = {r["model_used"] for r in scored.select("model_used").distinct().collect()}
    assert used == {"custom", "default"}
    assert scored.where("predicted_delivery_time_min is null").count() == 0


def test_unknown_level_is_all_zeros_and_bad_ordinal_fails(rows):
    prepared = fit_preparation(add_features(rows.where("split = 'train'")))
    odd = add_features(rows.limit(5).withColumn("weather", F.lit("Stormy")))
    hot = prepared.matrix(odd).select(*[c for c in prepared.matrix_sql() if c.startswith("weather_")])
    assert all(sum(r) == 0 for r in hot.collect())
    wrong = add_features(rows.limit(5).withColumn("traffic_level", F.lit("Jammed")))
    with pytest.raises(Exception, match="unknown level"):
        prepared.matrix(wrong).collect()


def test_rows_that_cannot_be_coded_get_the_default(spark, tables):
    from pyspark.sql import functions as F

    from courierflow import domain as D
    from courierflow.operators import metrics
    from courierflow.plans import retraining

    rows = tables.deliveries.where("hotel_id < 3")
    bad = rows.withColumn("traffic_level", F.when(F.col("order_id") % 2 == 0, "Jammed").otherwise(F.col("traffic_level")))
    weights = spark.createDataFrame([(h, [1.0] * (retraining.WIDTH - 1)) for h in range(3)], "hotel_id long, weights array<double>")
    scored = retraining.predict_for_hotels(bad, weights, F.lit(-5.0))
    used = {tuple(r) for r in scored.select(F.col("order_id") % 2 == 0, "model_used").distinct().collect()}
    assert used == {(True, "default"), (False, "custom")}
    eligible = {r["hotel_id"]: r["valid_rows"] for r in metrics.retrain_eligibility(bad, D.TARGET).collect()}
    trained = {r["hotel_id"]: r["count"] for r in retraining.training_rows(bad)[0].groupBy("hotel_id").count().collect()}
    assert {h: n for h, n in eligible.items() if n} == trained
    assert retraining.rejected_rows(bad).count() + sum(trained.values()) == bad.count()


def test_deep_trees_grown_by_leaves_equal_whole_trees(rows, monkeypatch):
    monkeypatch.setattr(regression, "ROWS_PER_SUBTREE", 200)
    placed = splitting.with_fold(rows.where("split = 'train'").limit(3000), folds=2)
    fit_rows, held = placed.where("fold = 0"), placed.where("fold = 1")
    matrix = regression.PipelineModel(regression.preparation_stages(fit_preparation(add_features(fit_rows))))
    fit_matrix = matrix.transform(fit_rows).select("features", D.TARGET).cache()
    held = matrix.transform(held).select("features", D.TARGET).cache()
    trees = {i: regression.tree(minInstancesPerNode=n) for i, n in enumerate([1, 4])}
    top = regression.top_depth(fit_matrix.count())
    assert top > 1 and all(regression.grows_deep(t, top) for t in trees.values())
    found = regression.deep_predictions(fit_matrix, held, trees, top).toPandas()
    for i, t in trees.items():
        want = t.fit(fit_matrix).transform(held).select(F.col(D.TARGET).alias("y"), "prediction").toPandas()
        mine = found[found["i"] == i]
        assert sorted(zip(mine["y"], mine["p"].round(9))) == sorted(zip(want["y"], want["prediction"].round(9)))


def test_grid_grows_no_deep_tree_whole(rows, monkeypatch):
    depths = []
    fit = regression.DecisionTreeRegressor._fit
    monkeypatch.setattr(
        regression.DecisionTreeRegressor, "_fit", lambda self, df: depths.append(self.getMaxDepth()) or fit(self, df)
    )
    grid = {"maxDepth": [3, regression.UNLIMITED_DEPTH], "minInstancesPerNode": [4]}
    found = regression.grid_search(rows.where("split = 'train'"), regression.tree, grid, folds=2)
    assert found.count() == 2 and max(depths) <= regression.SHALLOW_DEPTH


def small_matrix(rows, count=3000):
    placed = splitting.with_fold(rows.where("split = 'train'").limit(count), folds=2)
    fit_rows = placed.where("fold = 0")
    stages = regression.preparation_stages(fit_preparation(add_features(fit_rows)))
    made = (regression.PipelineModel(stages).transform(part) for part in (fit_rows, placed.where("fold = 1")))
    return [m.select("order_id", "features", D.TARGET).cache() for m in made]


def test_trees_grown_in_passes_equal_whole_trees(spark, rows, monkeypatch):
    monkeypatch.setattr(forests, "BLOCK_ROWS", 100)
    monkeypatch.setattr(forests, "SUM_BYTES", 20_000)  # groups of few trees
    fit_matrix, held = small_matrix(rows)
    wanted = {"a": regression.tree(maxDepth=5, minInstancesPerNode=4), "b": regression.tree(maxDepth=8)}
    (alike, bins, blocks), = regression.put_in_bins(fit_matrix, fit_matrix.count(), wanted)
    found = regression.grow_together(alike, bins, blocks)
    for name, tree in wanted.items():
        want = tree.fit(fit_matrix)
        as_spark = found[name].spark_model(spark)
        for part, most in ((fit_matrix, 0.0), (held, 0.01)):  # splits of equal gain part only the training rows alike
            guesses = [m.transform(part).orderBy("order_id").toPandas()["prediction"] for m in (want, found[name], as_spark)]
            assert np.allclose(guesses[1], guesses[2], atol=1e-9)
            assert (abs(guesses[0] - guesses[1]) > 1e-9).mean() <= most
        assert as_spark.numNodes >= want.numNodes and as_spark.depth == want.depth
        assert np.allclose(as_spark.featureImportances.toArray(), want.featureImportances.toArray(), atol=1e-3)


def test_a_forest_of_many_rows_is_grown_in_passes(rows, monkeypatch):
    monkeypatch.setattr(regression, "ROWS_OF_SPARK_ML", 1000)
    fitted = []
    fit = regression.RandomForestRegressor._fit
    monkeypatch.setattr(regression.RandomForestRegressor, "_fit", lambda self, df: fitted.append(df.count()) or fit(self, df))
    train = rows.where("split = 'train'")
    forest = regression.forest(maxDepth=6, numTrees=30, minInstancesPerNode=4)
    saved = regression.fit_models(train, {"forest": forest})["forest"]
    assert max(fitted, default=0) <= 2  # the two rows of an empty model
    monkeypatch.setattr(regression, "ROWS_OF_SPARK_ML", 10**9)
    by_spark = regression.fit_models(train, {"forest": forest})["forest"]
    report = regression.evaluate_models(rows, {"ours": saved, "theirs": by_spark}).collect()
    mae = {(r["model"], r["split"]): r["mae"] for r in report}
    assert saved.stages[-1].getNumTrees == 30
    assert all(abs(mae["ours", s] / mae["theirs", s] - 1) < 0.03 for s in ("train", "test"))
    trees = saved.stages[-1].trees
    assert len({t.numNodes for t in trees}) > 1  # each tree draws its own rows
    counted = [t.toDebugString for t in trees]
    assert len(set(counted)) == 30


def test_forest_draws_are_poisson_and_repeat():
    times = np.concatenate([forests.drawn((42, 7), block, 100_000) for block in range(5)])
    assert abs(times.mean() - 1) < 0.01 and abs(times.var() - 1) < 0.02
    assert (forests.drawn((42, 7), 3, 100_000) == times[300_000:400_000]).all()
    assert (forests.drawn((42, 8), 3, 100_000) != times[300_000:400_000]).any()


def test_cross_validated_forest_of_many_rows_is_grown_in_passes(rows, monkeypatch):
    monkeypatch.setattr(regression, "ROWS_OF_SPARK_ML", 100)
    monkeypatch.setattr(regression.RandomForestRegressor, "_fit", None)
    train = rows.where("split = 'train'")
    models = {"forest": regression.forest(maxDepth=4, numTrees=5), regression.BASELINE: None}
    found = {(r["model"], r["fold"]): r["mae"] for r in regression.cross_validate(train, models, folds=2).collect()}
    assert all(found["forest", f] < 0.8 * found[regression.BASELINE, f] for f in (0, 1))


def test_null_targets_are_refused_in_bins(spark):
    from pyspark.ml.linalg import Vectors

    matrix = spark.createDataFrame([(Vectors.dense([2.0]), 3.0), (Vectors.dense([1.0]), None)], ["features", D.TARGET])
    with pytest.raises(Exception, match="targets must not be null"):
        forests.binned(matrix, D.TARGET, forests.Bins([np.array([1.5])])).count()


def test_grid_of_many_rows_is_grown_and_scored_by_codes(rows, monkeypatch):
    train = rows.where("split = 'train'").limit(6000).cache()  # few enough for bins from all rows
    grid = {"maxDepth": [3, 6, regression.UNLIMITED_DEPTH], "minInstancesPerNode": [1, 4]}
    monkeypatch.setattr(regression, "ROWS_PER_SUBTREE", 400)
    want = {tuple(r[:2]): r["cv_mae"] for r in regression.grid_search(train, regression.tree, grid, folds=2).collect()}
    monkeypatch.setattr(regression, "ROWS_OF_SPARK_ML", 1000)
    monkeypatch.setattr(regression.DecisionTreeRegressor, "_fit", None)  # not one fit by Spark ML
    found = {tuple(r[:2]): r["cv_mae"] for r in regression.grid_search(train, regression.tree, grid, folds=2).collect()}
    assert found.keys() == want.keys() and len(found) == 6
    assert all(abs(found[s] / want[s] - 1) < 0.005 for s in want)  # splits of equal gain may differ


def test_grid_of_forests_shares_trees(rows, monkeypatch):
    monkeypatch.setattr(regression, "ROWS_OF_SPARK_ML", 1000)
    monkeypatch.setattr(regression.RandomForestRegressor, "_fit", None)
    grown = []
    grow = regression.grow
    monkeypatch.setattr(regression, "grow", lambda blocks, bins, rules: grown.append(len(rules)) or grow(blocks, bins, rules))
    grid = {"numTrees": [2, 5], "maxDepth": [2, 4], "minInstancesPerNode": [4]}
    found = regression.grid_search(rows.where("split = 'train'"), regression.forest, grid, folds=2).collect()
    assert len(found) == 4 and grown == [5, 5]
    assert {r["maxDepth"] for r in found if r["rank"] <= 2} == {4}


def test_subtrees_of_large_and_small_nodes_are_the_same(monkeypatch):
    source = np.random.default_rng(1)
    codes = np.stack([source.integers(0, w, 2000) for w in (30, 5, 2, 2, 2)], axis=1).astype(np.uint8)
    y = np.rint(codes @ [1.0, 4.0, 9.0, 2.0, 0.0] + source.normal(0, 5, 2000))
    bins = subtrees.Bins([np.arange(w - 1) + 0.5 for w in (30, 5, 2, 2, 2)])
    held = np.arange(2000) % 5 == 0
    found = []
    for rows_for_joint, at_once in ((0, 1), (10**9, 10**6), (20, 7)):
        monkeypatch.setattr(subtrees, "ROWS_FOR_JOINT", rows_for_joint)
        monkeypatch.setattr(subtrees, "NODES_AT_ONCE", at_once)
        found.append(subtrees.grown(codes, y, held, bins, subtrees.SubtreeRule(12, 2, 0.0)))
    assert (found[0] == found[1]).all() and (found[0] == found[2]).all()
    assert np.abs(found[0] - y)[held].mean() < 0.6 * np.abs(y - y.mean()).mean()
