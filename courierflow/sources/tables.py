"""Reading uploads, split tables and observations; writing splits, scores and exports."""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courierflow import domain as D
from courierflow.operators.columns import normalize_columns

CORRUPT = "_corrupt_record"

# Export columns as header and source column; text columns are quoted.
HISTORY_EXPORT = [
    ("ID", "id", False),
    ("Time_Logged", "created_at", True),
    ("Destination", "destination_address", True),
    ("Distance_km", "distance_km", False),
    ("Weather", "weather", True),
    ("Traffic_Level", "traffic_level", True),
    ("Time_of_Day", "time_of_day", True),
    ("Vehicle_Type", "vehicle_type", True),
    ("Prep_Time_min", "prep_time_min", False),
    ("Courier_Experience_yrs", "courier_exp_yrs", False),
    ("Predicted_Time_min", "predicted_time_min", False),
    ("Risk_Status", "risk_status", True),
    ("Source_Type", "source_type", True),
]


def read_delivery_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Delivery records in the standard layout, and the lines that do not fit it.

    Cells are read as text and judged by a cast, so which lines are bad does not
    depend on the columns a query asks for. Bad lines are in ``_corrupt_record``;
    where only a cell is wrong, its line is put together again from the cells.
    """
    fields = D.DELIVERY_SCHEMA.fields
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*(f.name for f in fields), CORRUPT]])
    rows = (
        spark.read.schema(text)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", False)
        .csv(path)
    )
    typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in fields}
    broken = F.col(CORRUPT).isNotNull()
    for name, value in typed.items():
        broken = broken | (F.col(name).isNotNull() & value.isNull())
    line = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*typed)))
    good = rows.where(~broken).select(*[value.alias(name) for name, value in typed.items()])
    bad = rows.where(broken).select(*[value.alias(name) for name, value in typed.items()], line.alias(CORRUPT))
    return good, bad


def file_heads(spark: SparkSession, path: str) -> DataFrame:
    """file and value: the first line that is not blank of every file below a path.

    Files in folders that all executors see are opened by their tasks, which read
    no further than that line. Spark's readers always read to the end, so files of
    other file systems cost a scan, summed up where it is read.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))  # contents stay unread
    mounted = F.col("file").startswith("file:")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file in batch.column(0).to_pylist():
                with _lines(file) as lines:
                    rows += [(file, line) for line in islice((line.rstrip("\r\n") for line in lines if line.strip()), 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["file", "value"])

    opened = files.where(mounted).mapInArrow(heads, "file string, value string")
    if files.where(~mounted).isEmpty():
        return opened
    lines = spark.read.text(path).select(F.url_decode("_metadata.file_path").alias("file"), "_metadata.file_block_start", "value")
    scanned = (
        lines.where((F.col("file_block_start") == 0) & (F.trim("value") != "") & ~mounted)
        .groupBy("file")
        .agg(F.min_by("value", F.monotonically_increasing_id()).alias("value"))
    )
    return opened.unionByName(scanned)


def _lines(file: str):
    """A text file opened by its path, which may begin with its scheme; a gzip file by its name."""
    place = file.removeprefix("file:")
    place = "/" + place.lstrip("/")
    opener = gzip.open if place.endswith(".gz") else open
    return opener(place, "rt", encoding="utf-8", errors="replace")


def files_by_header(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The CSV files below a path, grouped by their first line that is not blank."""
    found: dict[str, list[str]] = {}
    for row in sorted(file_heads(spark, path).collect()):
        found.setdefault(row["value"], []).append(row["file"])
    return found


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with any column names and order: names normalized, numbers parsed.

    Columns are planned per distinct header, so files below one path may name and
    order them differently; columns that a file lacks are null. Cells that are not
    numbers become null in a typed column and keep their text in ``<column>_text``.
    """
    reader = spark.read.option("header", True)
    groups = [reader.csv([_literal(f) for f in files]) for files in files_by_header(spark, path).values()]
    parts = [_planned(raw) for raw in groups or [reader.csv(path)]]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def _literal(file: str) -> str:
    """A file's path as a pattern that matches only that file."""
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in file)


def _planned(raw: DataFrame) -> DataFrame:
    named = normalize_columns(raw)
    present = {c.lower() for c in named.columns}
    numbers = [c for c in [*D.NUMERIC_FEATURES, D.TARGET] if c in present]
    kept_text = {
        f"{c}_text": F.when(F.col(c).try_cast("double").isNull(), F.col(c)) for c in numbers
    }
    return named.withColumns(kept_text).withColumns(
        {c: F.col(c).try_cast("double") for c in numbers}
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, quotes doubled inside quoted cells."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_split(df: DataFrame, path: str) -> None:
    """Rows by split, so that reading one split reads only its files."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split)


def split_metadata(df: DataFrame) -> DataFrame:
    """One-row description of a split table."""
    return df.agg(
        F.count("*").alias("total_samples"),
        F.count_if(F.col("split") == "train").alias("train_samples"),
        F.count_if(F.col("split") == "test").alias("test_samples"),
    ).select(
        "*",
        F.round(F.col("test_samples") / F.col("total_samples"), 4).alias("test_share"),
        F.lit(42).alias("random_state"),
        F.lit(D.TARGET).alias("target"),
        F.array(*[F.lit(c) for c in D.ALL_FEATURES]).alias("features"),
    )


def write_partitioned(df: DataFrame, path: str, by: str = "hotel_id") -> None:
    """Append-friendly output by hotel; each task writes only the hotels it holds.

    Rows are rebalanced by hotel: adaptive execution splits a hot hotel over as
    many tasks and files as its size asks for.
    """
    df.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(path)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Weather observations with their explicit schema."""
    return spark.read.schema(D.WEATHER_OBS_SCHEMA).parquet(path)


def _export_cell(column: str, quoted: bool) -> Column:
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    if not quoted:
        return text
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def history_header() -> str:
    return ",".join(header for header, _, _ in HISTORY_EXPORT)


def history_lines(history: DataFrame) -> DataFrame:
    """Export lines of the prediction history: text quoted, inner quotes doubled."""
    cells = [_export_cell(column, quoted) for _, column, quoted in HISTORY_EXPORT]
    return history.select(F.concat_ws(",", *cells).alias("line"))


def export_history(history: DataFrame, path: str) -> None:
    """History as CSV files with the export header."""
    named = history.select(*[F.col(column).alias(header) for header, column, _ in HISTORY_EXPORT])
    write_csv(named, path)


def evolve_columns(df: DataFrame, wanted: dict[str, Column]) -> DataFrame:
    """The wanted columns in order: kept where present, else added with their default."""
    present = {c.lower() for c in df.columns}
    return df.select(
        *[
            (F.coalesce(F.col(name), default) if name.lower() in present else default).alias(name)
            for name, default in wanted.items()
        ]
    )


def append_evolved(legacy: DataFrame, current: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Legacy rows in the current schema, stacked under the current rows.

    Columns the legacy table lacks take their default, or null.
    """
    stacked = current.unionByName(
        legacy.select(*[c for c in current.columns if c in legacy.columns]), allowMissingColumns=True
    )
    filled = {c: F.coalesce(F.col(c), default) for c, default in defaults.items()}
    return stacked.withColumns(filled)
