"""SRC*, SNK*: sources and sinks, as write-then-read round trips over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from courierflow import domain as D
from courierflow.catalog.base import query
from courierflow.catalog.dispatch import HISTORY_SQL, history_rows
from courierflow.catalog.features import COUNTRIES_SQL, PROFILES_SQL, profiles
from courierflow.catalog.learning import (
    FOLD_CTES,
    PRED_CTES,
    fold_scores,
    metric_table,
    split_rows,
    test_metrics,
    trained,
)
from courierflow.catalog.lookups import scored_orders
from courierflow.catalog.quality import SPLIT_SQL, VIOLATIONS_SQL, messy_names
from courierflow.operators import metrics, mutations, quality
from courierflow.plans import regression, retraining
from courierflow.session import work_path
from courierflow.sources import lookups, registry, tables
from courierflow.sources.binding import Tables


def quoted(text: str) -> str:
    return "'" + text.strip().replace("'", "''") + "'"


def values_sql(rows: list[tuple], columns: str) -> str:
    lines = [
        "(" + ", ".join(f"{c!r}::double" if isinstance(c, float) else quoted(c) for c in row) + ")"
        for row in rows
    ]
    return f"select * from (values {', '.join(lines)}) as v({columns})"


def uploaded(t: Tables):
    path = work_path(t.spark, "upload")
    tables.write_csv(messy_names(t), path)
    back = tables.read_upload(t.spark, path)
    return back.select(F.col("Order Ref").cast("bigint").alias("order_id"), *D.RAW_FEATURES, D.TARGET)


def uploads(t: Tables):
    """All deliveries in two sets of files: one with other names, one in the opposite order."""
    path = work_path(t.spark, "uploads")
    renamed = messy_names(t)
    tables.write_csv(renamed, f"{path}/renamed")
    plain = ["order_id", *D.RAW_FEATURES, D.TARGET]
    ordered = t.deliveries.select(*[F.col(c).alias("Order Ref" if c == "order_id" else c) for c in reversed(plain)])
    tables.write_csv(ordered, f"{path}/ordered")
    back = tables.read_upload(t.spark, f"{path}/*")
    return back.select(F.col("Order Ref").cast("bigint").alias("order_id"), *D.RAW_FEATURES, D.TARGET)


def delivery_csv(t: Tables):
    path = work_path(t.spark, "deliveries")
    columns = D.DELIVERY_SCHEMA.fieldNames()
    tables.write_csv(t.deliveries.select(*columns), path)
    good, _ = tables.read_delivery_csv(t.spark, path)
    return good


def loaded_split(t: Tables, split: str):
    path = work_path(t.spark, "split")
    tables.write_split(split_rows(t).select("order_id", "hotel_id", D.TARGET, "split"), path)
    return tables.read_split(t.spark, path, split)


def landmark_rows(t: Tables):
    """Customers with the landmarks of the preset city they belong to."""
    names = [city for city, *_ in lookups.CITIES]
    city = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("c_custkey") % 6 + 1).cast("int"))
    chosen = t.customer.select("c_custkey", city.alias("city"))
    joined = chosen.join(F.broadcast(lookups.city_presets(t.spark)), "city")
    return joined.select("c_custkey", "city", F.inline("landmarks"))


def sample_and_deliveries(t: Tables):
    sample = lookups.sample_template(t.spark, include_target=True).select(*D.RAW_FEATURES)
    return quality.violation_summary(t.deliveries.select(*D.RAW_FEATURES).unionByName(sample))


def observations(t: Tables):
    path = work_path(t.spark, "weather")
    t.weather_obs.write.parquet(path)
    return tables.read_observations(t.spark, path).withColumn(
        "obs_ts", F.date_format("obs_ts", "yyyy-MM-dd HH:mm:ss")
    )


def saved_metadata(t: Tables):
    path = work_path(t.spark, "metadata")
    document = tables.split_metadata(split_rows(t))
    registry.write_documents(document, path)
    back = registry.read_documents(t.spark, path, document.schema)
    return back.withColumn("features", F.array_join("features", ","))


def annotated(t: Tables):
    path = work_path(t.spark, "scored")
    tables.write_partitioned(scored_orders(t).select("id", "hotel_id", "predicted_eta_min", "risk_status"), path)
    back = t.spark.read.parquet(path)
    return back.select("id", F.col("hotel_id").cast("bigint").alias("hotel_id"), "predicted_eta_min", "risk_status")


def registry_table(t: Tables):
    """Three writes to one registry table; the later ones replace rows of the first."""
    path = work_path(t.spark, "model-registry")
    baseline = metrics.mean_baseline(split_rows(t), D.TARGET)
    rows = metric_table(t).select(
        "model", F.col("split").alias("type"), "mae", "mse", "rmse", "r2", F.lit("run").alias("notes")
    )
    registry.write_registry(t.spark, rows.where("type = 'train'"), path)
    registry.write_registry(t.spark, rows.where("type = 'test' and model <> 'eta_formula'"), path)
    return registry.write_registry(t.spark, registry.baseline_registry_row(baseline), path)


def baseline_document(t: Tables):
    path = work_path(t.spark, "baseline")
    document = registry.baseline_document(metrics.mean_baseline(split_rows(t), D.TARGET))
    registry.write_documents(document, path)
    back = registry.read_documents(t.spark, path, document.schema)
    return back.select("model_name", "strategy", "baseline_value_minutes", "sample_counts.*", "metrics.*")


def candidate(t: Tables):
    path = work_path(t.spark, "candidate")
    test = test_metrics(t)
    document = registry.candidate_document(metrics.generalization_gap(metric_table(t)), test, metrics.model_ranks(test))
    registry.write_documents(document, path)
    back = registry.read_documents(t.spark, path, document.schema)
    return back.select("selected_model", "test_metrics.*", "generalization_gap.*", "comparison_ranks.*")


def final_spec(t: Tables):
    path = work_path(t.spark, "final-spec")
    document = registry.final_document(metric_table(t), metrics.cv_summary(fold_scores(t)), "mean_baseline")
    registry.write_documents(document, path)
    back = registry.read_documents(t.spark, path, document.schema)
    return back.select("selected_algorithm", "feature_schema.total_features_to_model", "final_evaluation_metrics.*")


def custom_documents(t: Tables):
    """The document of each retrained hotel, written as JSON and read again; preparation times were not uploaded."""
    uploaded = t.deliveries.drop("preparation_time_min")
    report = retraining.retrain_hotels(uploaded)[1]
    documents = registry.retraining_documents(report, retraining.training_rows(uploaded)[1])
    path = work_path(t.spark, "hotel-documents")
    registry.write_documents(documents, path)
    found = registry.read_documents(t.spark, path, documents.schema)
    base, own = F.col("baseline_metrics.mae"), F.col("custom_model_metrics.mae")
    return found.select(
        "hotel_id", "total_samples", "train_samples", "test_samples", F.array_join("imputed_features", ",").alias("imputed"),
        (own < base).alias("better_than_mean"), (F.abs(F.col("mae_improvement_pct") - (base - own) / base * 100) < 0.01).alias("gain_fits"),
    )


def reloaded_model(t: Tables):
    """Predictions of a model before saving and after loading."""
    rows, model = trained(t)
    path = work_path(t.spark, "model")
    registry.save_model(model, path)
    before = regression.predict(rows, model).select("order_id", F.col(regression.PREDICTED).alias("before"))
    after = regression.predict(rows, registry.load_model(path)).select(
        "order_id", F.col(regression.PREDICTED).alias("after")
    )
    return before.join(after, "order_id").withColumn("same", F.col("before") == F.col("after"))


def history_table(t: Tables):
    logged = mutations.prediction_log(history_rows(t), "minutes", "batch")
    return logged.select(
        F.regexp_replace("order_reference", "ORD-", "").cast("bigint").alias("id"),
        F.lit("2024-05-01 10:00:00").alias("created_at"),
        F.concat(F.lit('Flat "'), "order_reference", F.lit('", Block 2')).alias("destination_address"),
        "distance_km", "weather", "traffic_level", "time_of_day", "vehicle_type", "prep_time_min", "courier_exp_yrs",
        "predicted_time_min", "risk_status", "source_type",
    )


def exported_history(t: Tables):
    path = work_path(t.spark, "history")
    tables.export_history(history_table(t), path)
    back = t.spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(
        F.col("ID").cast("bigint").alias("id"), F.col("Destination").alias("destination"), F.col("Risk_Status").alias("risk_status")
    )


def evolved(t: Tables):
    """Old rows lacking two columns under new rows that have them."""
    old = t.deliveries.where("order_id % 2 = 0").select("order_id", "distance_km", "weather")
    new = t.deliveries.where("order_id % 2 = 1").select("order_id", "distance_km", "weather", "vehicle_type", "time_of_day")
    return tables.append_evolved(old, new, {"vehicle_type": F.lit("Scooter")})


QUERIES = [
    query(
        "src1_read_upload",
        uploaded,
        """select order_id, distance_km, weather, traffic_level, time_of_day, vehicle_type, preparation_time_min, courier_experience_yrs,
        cast(delivery_time_min as double) as delivery_time_min from deliveries""",
    ),
    query(
        "src1_read_uploads",
        uploads,
        """select order_id, distance_km, weather, traffic_level, time_of_day, vehicle_type, preparation_time_min, courier_experience_yrs,
        cast(delivery_time_min as double) as delivery_time_min from (select * from deliveries union all select * from deliveries)""",
    ),
    query(
        "src1_read_delivery_csv",
        delivery_csv,
        "select " + ", ".join(D.DELIVERY_SCHEMA.fieldNames()[:-1])
        + ", cast(delivery_time_min as double) as delivery_time_min from deliveries",
    ),
    query(
        "src2_load_split",
        lambda t: loaded_split(t, "test"),
        "select order_id, hotel_id, delivery_time_min, split from split_rows where split = 'test'",
        split_rows=SPLIT_SQL,
    ),
    query(
        "src3_city_landmarks",
        landmark_rows,
        "select c_custkey, city, name, address, lat, lng from (select c_custkey, (["
        + ", ".join(quoted(city) for city, *_ in lookups.CITIES)
        + "])[c_custkey % 6 + 1] as city from customer) join landmark_rows using (city)",
        landmark_rows=values_sql(lookups.LANDMARKS, "city, name, address, lat, lng"),
    ),
    query(
        "src4_country_centroids",
        lambda t: profiles(t)
        .join(F.broadcast(lookups.country_centroids(t.spark)), "country")
        .groupBy("country", "lat", "lng")
        .agg(F.count("*").alias("profiles")),
        """select p.country, lat, lng, count(*) as profiles from profile_rows p join country_rows c on c.country = p.country
        group by all""",
        country_rows=COUNTRIES_SQL,
        profile_rows=PROFILES_SQL,
    ),
    query(
        "src5_sample_with_deliveries",
        sample_and_deliveries,
        """select violation, count(*) as rows from (select unnest(codes) as violation from violation_rows) group by violation""",
        stretched_rows="""select order_id, distance_km, weather, traffic_level, time_of_day, vehicle_type, preparation_time_min,
          courier_experience_yrs from deliveries union all select 0, distance_km, weather, traffic_level, time_of_day, vehicle_type,
          preparation_time_min, courier_experience_yrs from sample_rows""",
        sample_rows=values_sql(
            lookups.TRAINING_SAMPLE,
            "distance_km, weather, traffic_level, time_of_day, vehicle_type, preparation_time_min, courier_experience_yrs, delivery_time_min",
        ),
        violation_rows=VIOLATIONS_SQL,
    ),
    query(
        "src6_weather_observations",
        observations,
        "select obs_id, hotel_id, strftime(obs_ts, '%Y-%m-%d %H:%M:%S') as obs_ts, weathercode, windspeed from weather_obs",
    ),
    query(
        "snk1_split_metadata",
        saved_metadata,
        f"""select count(*) as total_samples, count(*) filter (split = 'train') as train_samples, count(*) filter (split = 'test') as test_samples,
        round(count(*) filter (split = 'test') / count(*), 4) as test_share, 42 as random_state, 'delivery_time_min' as target,
        '{",".join(D.ALL_FEATURES)}' as features from split_rows""",
        split_rows=SPLIT_SQL,
    ),
    query(
        "snk1_save_split",
        lambda t: loaded_split(t, "train"),
        "select order_id, hotel_id, delivery_time_min, split from split_rows where split = 'train'",
        split_rows=SPLIT_SQL,
    ),
    query(
        "snk2_annotated_output",
        annotated,
        """select id, hotel_id, predicted_eta_min, case when predicted_eta_min <= 35 then 'Fast / Low Risk' when predicted_eta_min <= 50
        then 'Standard / Medium Risk' else 'High Delay Risk' end as risk_status from dispatch_orders""",
    ),
    query(
        "snk3_registry_table",
        registry_table,
        """select model, split as type, mae, mse, rmse, r2, 'run' as notes from metric_rows
        where (split = 'test' and model <> 'eta_formula') or (split = 'train' and model = 'eta_formula')
        union all select 'Baseline (Training Mean)', 'Heuristic Baseline', mae, mse, rmse, r2,
          printf('Constant prediction (%.2f min) from the training mean', (select avg(delivery_time_min) from split_rows where split = 'train'))
        from metric_rows where model = 'mean_baseline' and split = 'test'""",
        **PRED_CTES,
    ),
    query(
        "snk4_baseline_document",
        baseline_document,
        """select 'Baseline (Training Mean)' as model_name, 'mean' as strategy,
        (select round(avg(delivery_time_min), 6) from split_rows where split = 'train') as baseline_value_minutes,
        (select count(*) from split_rows where split = 'train') as train_samples, n as test_samples, mae, rmse, r2
        from metric_rows where model = 'mean_baseline' and split = 'test'""",
        **PRED_CTES,
    ),
    query(
        "snk5_candidate_document",
        candidate,
        """select model as selected_model, b.mae, b.mse, b.rmse, b.r2, round(b.mae - a.mae, 4) as mae_gap, round(b.rmse - a.rmse, 4) as rmse_gap,
        round(b.r2 - a.r2, 4) as r2_gap, cast(b.k as int) as mae_rank, cast(b.k2 as int) as rmse_rank, cast(b.k3 as int) as r2_rank
        from (select * from metric_rows where split = 'train') a join (select *, rank() over (order by mae) as k, rank() over (order by rmse) as k2,
          rank() over (order by r2 desc) as k3 from metric_rows where split = 'test') b using (model) order by b.k, b.k2, model limit 1""",
        **PRED_CTES,
    ),
    query(
        "snk5_final_document",
        final_spec,
        """select model as selected_algorithm, 12 as total_features_to_model, a.mae as train_mae, a.rmse as train_rmse, a.r2 as train_r2,
        cv_mae, cv_rmse, cv_r2, b.mae as test_mae, b.rmse as test_rmse, b.r2 as test_r2
        from (select * from metric_rows where split = 'train') a join (select * from metric_rows where split = 'test') b using (model)
        join cv_rows using (model) where model = 'mean_baseline'""",
        **PRED_CTES,
        **FOLD_CTES,
    ),
    query(
        "snk5_custom_document",
        custom_documents,
        """select hotel_id, n as total_samples, n - greatest(2, n // 5) as train_samples, greatest(2, n // 5) as test_samples,
        'preparation_time_min' as imputed, true as better_than_mean, true as gain_fits
        from (select hotel_id, count(*) as n from deliveries group by hotel_id) where n >= 10""",
    ),
    query("snk6_reloaded_model", reloaded_model),
    query(
        "snk6_reloaded_rows",
        lambda t: reloaded_model(t).select("order_id", "same"),
        "select order_id, true as same from deliveries",
    ),
    query(
        "snk7_history_lines",
        lambda t: tables.history_lines(history_table(t)),
        """select id || ',"2024-05-01 10:00:00","Flat ""ORD-' || id || '"", Block 2",' || distance_km || ',"' || weather || '","' || traffic_level
          || '","' || time_of_day || '","' || vehicle_type || '",' || prep_time_min || ',' || courier_exp_yrs || ',' || predicted_time_min || ',"'
          || risk_status || '","' || source_type || '"' as line
        from (select *, replace(order_reference, 'ORD-', '') as id from history_rows)""",
        history_rows=HISTORY_SQL,
    ),
    query(
        "snk7_exported_history",
        exported_history,
        """select cast(replace(order_reference, 'ORD-', '') as bigint) as id, 'Flat "' || order_reference || '", Block 2' as destination, risk_status
        from history_rows""",
        history_rows=HISTORY_SQL,
    ),
    query(
        "snk8_evolved_table",
        evolved,
        """select order_id, distance_km, weather, case when order_id % 2 = 0 then 'Scooter' else vehicle_type end as vehicle_type,
        case when order_id % 2 = 1 then time_of_day end as time_of_day from deliveries""",
    ),
]
