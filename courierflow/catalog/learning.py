"""AG8-AG13, ML*, RK8, JN11, SNK3: evaluation, training, scoring and the model registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from courierflow import domain as D
from courierflow.catalog.base import py_round_sql, query
from courierflow.catalog.features import old_and_new_hotels
from courierflow.catalog.quality import FEATURED_SQL, SPLIT_SQL, long_levels
from courierflow.functions.features import add_features
from courierflow.functions.scalars import delay_risk
from courierflow.operators import matching, metrics, splitting
from courierflow.plans import regression, retraining
from courierflow.sources import registry
from courierflow.sources.binding import Tables


def split_rows(t: Tables):
    return splitting.with_split(t.deliveries)


def formula():
    return F.round(F.lit(12.0) + F.col("distance_km") * 3.0 + F.col("preparation_time_min"), 2)


def predictions(t: Tables):
    """Three simple models: training mean, distance trend of the training rows, fixed formula."""
    rows = split_rows(t)
    fit = (
        rows.where("split = 'train'")
        .agg(
            F.struct(
                F.avg(D.TARGET).alias("mean"),
                F.regr_slope(D.TARGET, "distance_km").alias("slope"),
                F.regr_intercept(D.TARGET, "distance_km").alias("intercept"),
            )
        )
        .scalar()
    )
    guesses = {
        "mean_baseline": fit["mean"],
        "distance_trend": fit["intercept"] + fit["slope"] * F.col("distance_km"),
        "eta_formula": formula(),
    }
    pairs = [F.struct(F.lit(n).alias("model"), p.alias("predicted")) for n, p in guesses.items()]
    return rows.select("order_id", "split", D.TARGET, F.inline(F.array(*pairs)))


PREDICTIONS_SQL = """
select order_id, split, delivery_time_min, model, case model when 'mean_baseline' then mean
  when 'distance_trend' then intercept + slope * distance_km else round(12 + distance_km * 3.0e0 + preparation_time_min, 2) end as predicted
from split_rows, (select avg(delivery_time_min) as mean, regr_slope(delivery_time_min, distance_km) as slope,
  regr_intercept(delivery_time_min, distance_km) as intercept from split_rows where split = 'train'),
(values ('mean_baseline'), ('distance_trend'), ('eta_formula')) as m(model)
"""


def metrics_sql(by: str, table: str, actual: str = "delivery_time_min", predicted: str = "predicted") -> str:
    e = f"({actual} - {predicted})"
    return f"""select {by}, count(*) as n, round(avg(abs({e})), 4) as mae, round(avg({e} * {e}), 4) as mse,
    round(sqrt(avg({e} * {e})), 4) as rmse,
    round(1 - sum({e} * {e}) / nullif(var_pop({actual}) * count({actual}), 0), 4) as r2 from {table} group by {by}"""


PRED_CTES = {
    "split_rows": SPLIT_SQL,
    "prediction_rows": PREDICTIONS_SQL,
    "metric_rows": metrics_sql("model, split", "prediction_rows"),
}


def metric_table(t: Tables):
    return metrics.regression_metrics(predictions(t), D.TARGET, "predicted", ["model", "split"])


def test_metrics(t: Tables):
    return metric_table(t).where("split = 'test'").drop("split")


FOLD = "cast(('0x' || left(md5(order_id || '|fold42'), 15))::bigint % 5 as int)"


def fold_scores(t: Tables):
    """Per-fold metrics of the mean baseline and the fixed formula."""
    base = metrics.baseline_folds(t.deliveries, "order_id", D.TARGET).withColumn(
        "model", F.lit("mean_baseline")
    )
    placed = splitting.with_fold(t.deliveries).withColumn("predicted", formula())
    fixed = metrics.regression_metrics(placed, D.TARGET, "predicted", ["fold"]).withColumn(
        "model", F.lit("eta_formula")
    )
    return base.unionByName(fixed)


BASE_FOLDS_SQL = metrics_sql("fold", "fold_guess", "y")
FOLD_CTES = {
    "fold_rows": f"""select {FOLD} as fold, delivery_time_min as y,
        round(12 + distance_km * 3.0e0 + preparation_time_min, 2) as predicted from deliveries""",
    "fold_guess": """select fold, y, (tot - own) / (cnt - own_cnt) as predicted from fold_rows
        join (select fold as f, sum(y) as own, count(y) as own_cnt from fold_rows group by fold) on fold = f,
        (select sum(y) as tot, count(y) as cnt from fold_rows)""",
    "base_folds": BASE_FOLDS_SQL,
    "formula_folds": metrics_sql("fold", "fold_rows", "y"),
    "fold_scores": """select 'mean_baseline' as model, * from base_folds
        union all select 'eta_formula' as model, * from formula_folds""",
    "cv_rows": """select model, round(avg(mae), 4) as cv_mae, round(stddev_pop(mae), 4) as cv_mae_std,
        round(avg(rmse), 4) as cv_rmse, round(stddev_pop(rmse), 4) as cv_rmse_std,
        round(avg(r2), 4) as cv_r2, round(stddev_pop(r2), 4) as cv_r2_std from fold_scores group by model""",
}


TRAIN_FOLDS_SQL = f"""
select fold, cnt as n, round(avg(abs(y - (tot - own) / (total - cnt))), 4) as mean_mae
from (select fold, y, sum(y) over (partition by fold) as own, count(*) over (partition by fold) as cnt,
    sum(y) over () as tot, count(*) over () as total
  from (select {FOLD} as fold, delivery_time_min as y from split_rows where split = 'train')) group by fold, cnt
"""


def linear_folds(t: Tables):
    """Held-out error of the mean and whether the linear model is below it, per fold of the training rows."""
    train = split_rows(t).where("split = 'train'")
    folds = regression.cross_validate(train, {"linear": regression.linear(), regression.BASELINE: None})
    pick = {m: F.max(F.when(F.col("model") == m, F.col("mae"))) for m in ("linear", regression.BASELINE)}
    return folds.groupBy("fold").agg(
        F.max("n").alias("n"), pick[regression.BASELINE].alias("mean_mae"),
        (pick["linear"] < pick[regression.BASELINE]).alias("linear_is_better"),
    )


def sliced(t: Tables):
    return add_features(t.deliveries).withColumns(
        {"formula": formula(), "flat": F.lit(45.0)}
    )


SLICED_SQL = """
select *, abs(delivery_time_min - round(12 + distance_km * 3.0e0 + preparation_time_min, 2)) as ef, abs(delivery_time_min - 45.0e0) as eb,
  case when delivery_time_min <= 0 then null when delivery_time_min <= 35 then 'Fast (<35 min)' when delivery_time_min <= 70 then 'Typical (35-70)'
    when delivery_time_min <= 150 then 'Prolonged (>70)' end as duration_tier
from featured
"""
SLICE_DIMS = ["distance_category", "weather", "traffic_level", "severe_conditions", "duration_tier"]


def registry_updates(t: Tables):
    """Registry rows of two runs; the later run repeats the earlier models."""
    rows = metric_table(t)
    typed = rows.select(
        "model", F.col("split").alias("type"), "mae", "mse", "rmse", "r2", F.lit("run").alias("notes")
    )
    return typed.where("type = 'train'"), typed.where("type = 'test' and model <> 'eta_formula'")


def pruned_targets(t: Tables):
    """Targets as text, some of them unusable, also spread over many hotels with few rows each."""
    key = F.col("order_id")
    text = (
        F.when(key % 7 == 0, F.lit("n/a"))
        .when(key % 11 == 0, F.lit("-4"))
        .otherwise(F.col(D.TARGET).cast("string"))
    )
    rows = t.deliveries.withColumn(D.TARGET, text)
    return rows.unionByName(rows.withColumn("hotel_id", F.floor(key / 13) + 1000))


def faulty_rows(t: Tables):
    """Deliveries, some with a target, distance or traffic level that cannot be trained on."""
    key = F.col("order_id")
    return t.deliveries.withColumns(
        {
            D.TARGET: F.when(key % 7 == 0, F.lit("n/a")).otherwise(F.col(D.TARGET).cast("string")),
            "distance_km": F.when(key % 13 == 0, F.lit(-1.0)).otherwise(F.col("distance_km")),
            "traffic_level": F.when(key % 17 == 0, F.lit("Jammed")).otherwise(F.col("traffic_level")),
        }
    )


def trained(t: Tables):
    rows = split_rows(t)
    return rows, regression.fit_model(rows.where("split = 'train'"), regression.linear())


def scored_batch(t: Tables):
    rows, model = trained(t)
    scored, _ = regression.score_batch(rows, model)
    return scored.select("order_id", regression.PREDICTED, "risk_status")


def scored_by_hotel(t: Tables):
    """All deliveries scored by the models of their hotels; some hotels have none, some rows do not fit."""
    weights, _ = retraining.retrain_hotels(t.deliveries)
    key = F.col("order_id")
    jammed = F.when(key % 17 == 0, F.lit("Jammed")).otherwise(F.col("traffic_level"))
    asked = t.deliveries.withColumns({"hotel_id": key % 30, "traffic_level": jammed})
    return retraining.predict_for_hotels(asked, weights, regression.fallback_minutes(F.col("distance_km")))


def hotel_reports(t: Tables):
    return retraining.retrain_hotels(t.deliveries)[1]


QUERIES = [
    query(
        "ag8_slice_errors",
        lambda t: metrics.slice_errors(sliced(t), D.TARGET, ["formula", "flat"]),
        """select dim, level, count(*) as n, round(avg(ef), 4) as mae_formula, round(avg(eb), 4) as mae_flat
        from levels where level is not null group by dim, level""",
        featured=FEATURED_SQL,
        sliced_rows=SLICED_SQL,
        levels=long_levels(SLICE_DIMS, "sliced_rows", "ef, eb"),
    ),
    query(
        "ag9_regression_metrics",
        metric_table,
        "select * from metric_rows",
        **PRED_CTES,
    ),
    query(
        "ag10_mean_baseline",
        lambda t: metrics.mean_baseline(split_rows(t), D.TARGET),
        """select (select round(avg(delivery_time_min), 6) from split_rows where split = 'train') as baseline_value,
        (select count(*) from split_rows where split = 'train') as train_rows, n as test_rows, mae, mse, rmse, r2
        from metric_rows where model = 'mean_baseline' and split = 'test'""",
        **PRED_CTES,
    ),
    query(
        "ag10_baseline_preview",
        lambda t: metrics.baseline_preview(split_rows(t), D.TARGET),
        """select order_id, delivery_time_min as actual, round(predicted, 4) as predicted,
        round(abs(delivery_time_min - predicted), 4) as abs_error,
        case when predicted > delivery_time_min then 'Overestimate' else 'Underestimate' end as direction
        from prediction_rows where model = 'mean_baseline' and split = 'test'""",
        **PRED_CTES,
    ),
    query(
        "ag11_cv_summary",
        lambda t: metrics.cv_summary(fold_scores(t)),
        """select *, case when cv_mae_std < 0.5 then 'Highly Stable' when cv_mae_std < 0.8 then 'Moderate Stability'
        else 'High Variance / Unstable' end as stability from cv_rows""",
        **FOLD_CTES,
    ),
    query(
        "ag12_fold_matrix",
        lambda t: metrics.fold_matrix(fold_scores(t)),
        "select model, "
        + ", ".join(
            f"max({m}) filter (fold = {i}) as {m}_fold_{i + 1}" for m in ("mae", "r2") for i in range(5)
        )
        + " from fold_scores group by model",
        **FOLD_CTES,
    ),
    query(
        "ag13_residual_profile",
        lambda t: metrics.residual_profile(predictions(t), D.TARGET, "predicted", ["model", "split"]),
        """select model, split, round(avg(delivery_time_min - predicted), 4) as mean_residual,
        round(avg(abs(delivery_time_min - predicted)), 4) as mean_abs_residual,
        round(avg(cast(abs(delivery_time_min - predicted) <= 7 as int)), 4) as share_within_7,
        count(*) filter (delivery_time_min < predicted) as overestimated,
        count(*) filter (delivery_time_min >= predicted) as underestimated from prediction_rows group by model, split""",
        **PRED_CTES,
    ),
    query(
        "rk8_model_ranks",
        lambda t: metrics.model_ranks(test_metrics(t)),
        " union all ".join(
            f"select '{m}' as criterion, model, {m} as score, cast(rank() over (order by {m} {d}) as int) as rank "
            "from metric_rows where split = 'test'"
            for m, d in (("mae", ""), ("rmse", ""), ("r2", "desc"))
        ),
        **PRED_CTES,
    ),
    query(
        "jn11_cv_against_test",
        lambda t: matching.cv_against_test(
            metrics.cv_summary(fold_scores(t)).select("model", "cv_mae", "cv_rmse", "cv_r2"),
            test_metrics(t).select("model", "mae", "rmse", "r2"),
        ),
        """select model, cv_mae, cv_rmse, cv_r2, mae, rmse, r2, round(mae - cv_mae, 4) as mae_diff,
        round(rmse - cv_rmse, 4) as rmse_diff, round(r2 - cv_r2, 4) as r2_diff
        from cv_rows join metric_rows using (model) where split = 'test'""",
        **FOLD_CTES,
        **PRED_CTES,
    ),
    query(
        "ml1_train_linear",
        lambda t: regression.train_and_evaluate(split_rows(t), {"linear_regression": regression.linear()}),
    ),
    query(
        "ml2_candidate_models",
        lambda t: regression.train_and_evaluate(split_rows(t), regression.tuned_regressors()),
    ),
    query(
        "ml3_test_comparison",
        lambda t: metrics.lift_over_baseline(
            regression.train_and_evaluate(
                split_rows(t), regression.tuned_regressors()
            ).where("split = 'test'"),
            regression.BASELINE,
        ),
    ),
    query(
        "ml4_cross_validation",
        lambda t: metrics.cv_summary(
            regression.cross_validate(
                split_rows(t).where("split = 'train'"), {**regression.tuned_regressors(), regression.BASELINE: None}
            )
        ),
    ),
    query(
        "ml4_linear_folds",
        linear_folds,
        "select *, true as linear_is_better from train_folds",
        split_rows=SPLIT_SQL,
        train_folds=TRAIN_FOLDS_SQL,
    ),
    query(
        "ml5_tree_grid",
        lambda t: regression.grid_search(
            split_rows(t).where("split = 'train'"), regression.tree, regression.TREE_GRID
        ),
    ),
    query(
        "ml6_baseline_folds",
        lambda t: metrics.baseline_folds(t.deliveries, "order_id", D.TARGET),
        "select * from base_folds",
        **FOLD_CTES,
    ),
    query(
        "ml7_lift_over_baseline",
        lambda t: metrics.lift_over_baseline(test_metrics(t), "mean_baseline"),
        """select model, mae, rmse, round(b_mae - mae, 4) as mae_reduction, round((b_mae - mae) / b_mae * 100.0e0, 2) as mae_lift_pct,
        round(b_rmse - rmse, 4) as rmse_reduction, round((b_rmse - rmse) / b_rmse * 100.0e0, 2) as rmse_lift_pct
        from metric_rows, (select mae as b_mae, rmse as b_rmse from metric_rows where model = 'mean_baseline' and split = 'test')
        where split = 'test'""",
        **PRED_CTES,
    ),
    query(
        "ml8_generalization_gap",
        lambda t: metrics.generalization_gap(metric_table(t)),
        """select a.model, round(b.mae - a.mae, 4) as mae_gap, round(b.rmse - a.rmse, 4) as rmse_gap, round(b.r2 - a.r2, 4) as r2_gap
        from metric_rows a join metric_rows b on a.model = b.model and a.split = 'train' and b.split = 'test'""",
        **PRED_CTES,
    ),
    query("ml9_batch_prediction", scored_batch),
    query(
        "ml9_batch_risks",
        lambda t: scored_batch(t).select(
            "order_id",
            (F.col("risk_status") == delay_risk(F.col(regression.PREDICTED))).alias("risk_fits"),
            F.col(regression.PREDICTED).between(0, 300).alias("in_range"),
        ),
        "select order_id, true as risk_fits, true as in_range from deliveries",
    ),
    query(
        "jn10_score_by_hotel",
        lambda t: scored_by_hotel(t).select(
            "order_id", "model_used", F.col("predicted_delivery_time_min").isNotNull().alias("scored")
        ),
        """select order_id, case when n >= 10 and order_id % 17 <> 0 then 'custom' else 'default' end as model_used, true as scored
        from deliveries d left join (select hotel_id as h, count(*) as n from deliveries group by 1) on h = order_id % 30""",
    ),
    query("ml10_retrain_hotels", hotel_reports),
    query(
        "ml10_report_counts",
        lambda t: hotel_reports(t).select(
            "hotel_id", "total_samples", "train_samples", "test_samples", "folds",
            (F.col("model_mae") < F.col("baseline_mae")).alias("better_than_mean"),
        ),
        """select hotel_id, n as total_samples, n - greatest(2, n // 5) as train_samples, greatest(2, n // 5) as test_samples,
        least(5, greatest(2, (n - greatest(2, n // 5)) // 3)) as folds, true as better_than_mean
        from (select hotel_id, count(*) as n from deliveries group by hotel_id) where n >= 10""",
    ),
    query(
        "ml10_rejected_rows",
        lambda t: retraining.rejected_rows(faulty_rows(t)).select(
            "order_id", "hotel_id", F.array_join("faults", ",").alias("faults")
        ),
        """select order_id, hotel_id, concat_ws(',', case when order_id % 7 = 0 then 'target_not_positive' end,
          case when order_id % 13 = 0 then 'distance_not_positive' end, case when order_id % 17 = 0 then 'unknown_traffic' end) as faults
        from deliveries where order_id % 7 = 0 or order_id % 13 = 0 or order_id % 17 = 0""",
    ),
    query(
        "ml11_retrain_eligibility",
        lambda t: metrics.retrain_eligibility(pruned_targets(t), D.TARGET),
        """select hotel_id, n as valid_rows, n >= 10 as eligible, case when n >= 10 then greatest(2, n // 5) end as test_rows,
        case when n >= 10 then n - greatest(2, n // 5) end as train_rows,
        case when n >= 10 then least(5, greatest(2, (n - greatest(2, n // 5)) // 3)) end as folds
        from (select hotel_id, count(*) filter (order_id % 7 <> 0 and order_id % 11 <> 0) as n
          from (select hotel_id, order_id from deliveries union all select order_id // 13 + 1000, order_id from deliveries) group by hotel_id)""",
    ),
    query(
        "ml12_model_status",
        lambda t: retraining.model_status(t.hotels, hotel_reports(t)),
    ),
    query(
        "ml12_report_counts",
        lambda t: retraining.model_status(
            old_and_new_hotels(t), hotel_reports(t)
        ).select("hotel_id", "total_samples", "custom_model_available"),
        """select hotel_id, case when n >= 10 then n end as total_samples, coalesce(n >= 10, false) as custom_model_available
        from (select hotel_id from hotels union all select hotel_id + 1000 from hotels)
        left join (select hotel_id, count(*) as n from deliveries group by hotel_id) using (hotel_id)""",
    ),
    query(
        "ml13_fallback_eta",
        lambda t: t.deliveries.select(
            "order_id",
            F.coalesce(
                F.when(F.col("weather").isNotNull() & F.col("traffic_level").isNotNull(), formula()),
                regression.fallback_minutes(F.col("distance_km")),
            ).alias("eta_min"),
        ),
        f"""select order_id, case when weather is not null and traffic_level is not null
        then round(12 + distance_km * 3.0e0 + preparation_time_min, 2) else {py_round_sql("(15 + distance_km * 2.5e0)", 1)} end as eta_min
        from deliveries""",
    ),
    query(
        "snk3_registry_upsert",
        lambda t: registry.merge_registry(*registry_updates(t)),
        """select model, split as type, mae, mse, rmse, r2, 'run' as notes from metric_rows
        where (split = 'test' and model <> 'eta_formula') or (split = 'train' and model = 'eta_formula')""",
        **PRED_CTES,
    ),
]
