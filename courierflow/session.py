"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on: event times are compared in UTC, and AQE
# coalesces small shuffle partitions and splits skewed join partitions.
SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM does not compile methods beyond 8000 bytes; wide projections over
    # that size run faster operator by operator than fused and interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app_name: str = "courierflow", **settings: str) -> SparkSession:
    """Start (or reuse) a session with the library's settings plus ``settings``."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SESSION_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the runtime-changeable library settings on an existing session."""
    for key, value in SESSION_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where the session names none, a local session gets a fresh folder, set as its
    checkpoint folder. On a cluster that is an error: executors do not share the
    driver's disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="courierflow-"))
    return spark.sparkContext.getCheckpointDir()


def work_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder for one written table."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows written once as a table in the shared folder and read back.

    For results several later steps read: their work is not repeated, and a lost
    executor costs a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
