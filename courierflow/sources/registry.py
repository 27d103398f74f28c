"""Model registry table and model documents."""

from __future__ import annotations

from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courierflow import domain as D
from courierflow.operators.listing import latest_row
from courierflow.session import work_path


def merge_registry(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """Registry with the updates added; of several rows of a model the latest stays."""
    columns = D.MODEL_REGISTRY_SCHEMA.fieldNames()
    stacked = existing.select(*columns, F.lit(0).alias("_run")).unionByName(
        updates.select(*columns, F.lit(1).alias("_run"))
    )
    return latest_row(stacked, ["_run"], ["model"]).drop("_run")


def write_registry(spark: SparkSession, updates: DataFrame, path: str) -> DataFrame:
    """Upsert into the registry table at ``path``.

    The merged rows are written aside first: a table cannot be overwritten while
    it is being read.
    """
    try:
        existing = spark.read.schema(D.MODEL_REGISTRY_SCHEMA).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        existing = spark.createDataFrame([], D.MODEL_REGISTRY_SCHEMA)
    aside = work_path(spark, "registry")
    merge_registry(existing, updates).write.parquet(aside)
    merged = spark.read.schema(D.MODEL_REGISTRY_SCHEMA).parquet(aside)
    merged.write.mode("overwrite").parquet(path)
    return spark.read.schema(D.MODEL_REGISTRY_SCHEMA).parquet(path)


def baseline_document(baseline: DataFrame) -> DataFrame:
    """Mean-baseline figures as one nested document row."""
    return baseline.select(
        F.lit("Baseline (Training Mean)").alias("model_name"),
        F.lit("heuristic_baseline").alias("model_type"),
        F.lit(False).alias("is_ml_model"),
        F.lit("mean").alias("strategy"),
        F.col("baseline_value").alias("baseline_value_minutes"),
        F.struct(
            F.col("train_rows").alias("train_samples"), F.col("test_rows").alias("test_samples")
        ).alias("sample_counts"),
        F.struct("mae", "rmse", "r2").alias("metrics"),
    )


def baseline_registry_row(baseline: DataFrame) -> DataFrame:
    note = F.format_string("Constant prediction (%.2f min) from the training mean", "baseline_value")
    return baseline.select(
        F.lit("Baseline (Training Mean)").alias("model"),
        F.lit("Heuristic Baseline").alias("type"),
        "mae",
        "mse",
        "rmse",
        "r2",
        note.alias("notes"),
    )


def candidate_document(gap: DataFrame, test: DataFrame, ranks: DataFrame) -> DataFrame:
    """The best model by rank, with its holdout metrics, gaps and ranks."""
    ranked = ranks.groupBy("model").agg(
        F.max(F.when(F.col("criterion") == "mae", F.col("rank"))).alias("mae_rank"),
        F.max(F.when(F.col("criterion") == "rmse", F.col("rank"))).alias("rmse_rank"),
        F.max(F.when(F.col("criterion") == "r2", F.col("rank"))).alias("r2_rank"),
    )
    joined = test.join(gap, "model").join(ranked, "model")
    document = F.struct(
        F.col("model").alias("selected_model"),
        F.struct("mae", "mse", "rmse", "r2").alias("test_metrics"),
        F.struct("mae_gap", "rmse_gap", "r2_gap").alias("generalization_gap"),
        F.struct("mae_rank", "rmse_rank", "r2_rank").alias("comparison_ranks"),
    )
    best: Column = F.struct("mae_rank", "rmse_rank", "model")
    return joined.agg(F.min_by(document, best).alias("d")).select("d.*")


def final_document(metrics: DataFrame, cv: DataFrame, model: str) -> DataFrame:
    """Final specification of one model: features and train, cross-validation and test metrics."""

    def of(split: str, name: str) -> Column:
        return F.max(F.when(F.col("split") == split, F.col(name))).alias(f"{split}_{name}")

    holdout = metrics.where(F.col("model") == model).groupBy("model").agg(
        *[of(s, m) for s in ("train", "test") for m in ("mae", "rmse", "r2")]
    )
    return holdout.join(cv.select("model", "cv_mae", "cv_rmse", "cv_r2"), "model").select(
        F.col("model").alias("selected_algorithm"),
        F.struct(
            F.array(*[F.lit(c) for c in D.RAW_FEATURES]).alias("raw_input_features"),
            F.array(*[F.lit(c) for c in D.ENGINEERED_FEATURES]).alias("engineered_features"),
            F.lit(len(D.ALL_FEATURES)).alias("total_features_to_model"),
        ).alias("feature_schema"),
        F.struct(
            "train_mae", "train_rmse", "train_r2", "cv_mae", "cv_rmse", "cv_r2", "test_mae", "test_rmse", "test_r2"
        ).alias("final_evaluation_metrics"),
    )


def retraining_documents(report: DataFrame, imputed: list[str]) -> DataFrame:
    """One document per retrained hotel."""
    return report.select(
        "hotel_id",
        "total_samples",
        "train_samples",
        "test_samples",
        F.array(*[F.lit(c) for c in imputed]).cast("array<string>").alias("imputed_features"),
        F.struct(F.col("baseline_mae").alias("mae")).alias("baseline_metrics"),
        F.struct(
            F.col("model_mae").alias("mae"), F.col("model_rmse").alias("rmse"), F.col("model_r2").alias("r2")
        ).alias("custom_model_metrics"),
        "cv_mae",
        "mae_improvement_pct",
    )


def write_documents(documents: DataFrame, path: str) -> None:
    """JSON documents, one per line."""
    documents.write.mode("overwrite").json(path)


def read_documents(spark: SparkSession, path: str, schema: Any) -> DataFrame:
    return spark.read.schema(schema).json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def document_text(documents: DataFrame) -> DataFrame:
    """Documents as JSON text."""
    return documents.select(F.to_json(F.struct("*")).alias("document"))

