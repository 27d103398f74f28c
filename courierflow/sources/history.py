"""Observations in a day-partitioned table that answers "what held at that time" from a few days.

Besides the observations themselves the table has, for each day, the last observation
of every key before the day began. So the observation in force at a time is among the rows of
that time's day, whatever the age of the last one, and a batch of orders reads the days
it mentions and no other. Additions are versions: version n has the observations of one
batch, and the carried rows of all days that they change. A batch that is
repeated replaces its own version.

Layout: ``observed/version=n/day=d``, ``carried/version=n/day=d`` and ``span/version=n``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def _part(path: str, kind: str, version: int | None = None) -> str:
    return f"{path}/{kind}" if version is None else f"{path}/{kind}/version={version:012d}"


def add_observations(rows: DataFrame, path: str, version: int, key: str, ts: str, tie: str) -> None:
    """Add a batch of observations (``key``, time ``ts``, ``tie`` to order equal times, any others) as ``version``.

    Versions are numbered from 0 without gaps. Late observations are allowed: the carried rows
    of all days after the first one in the batch are written anew.
    """
    spark = rows.sparkSession
    dated = rows.where(F.col(ts).isNotNull()).withColumn("day", F.to_date(ts))
    dated.write.mode("overwrite").partitionBy("day").parquet(_part(path, "observed", version))
    fresh = spark.read.schema(dated.schema).parquet(_part(path, "observed", version))
    first, last = fresh.agg(F.min("day"), F.max("day")).first()
    before = span(spark, path, version - 1) if version else None
    days = [d for d in (first, last, *(before or ())) if d is not None]
    extent = spark.createDataFrame([(min(days, default=None), max(days, default=None))], "first_day date, last_day date")
    if first is not None:
        known = [fresh]
        if before:
            # what held before the first changed day, or after all days known so far
            seed = F.least(F.lit(first), F.date_add(F.lit(before[1]), 1))
            older = _versions(spark, path, "observed", version, dated).where(F.col("day") >= F.lit(first))
            held = _versions(spark, path, "carried", version, dated).where(F.col("day") == seed)
            known += [older, _latest(held, key)]
        carried = _carried(known, key, ts, tie, max(days))
        carried.write.mode("overwrite").partitionBy("day").parquet(_part(path, "carried", version))
    else:
        dated.limit(0).write.mode("overwrite").partitionBy("day").parquet(_part(path, "carried", version))
    extent.coalesce(1).write.mode("overwrite").parquet(_part(path, "span", version))


def _carried(known: list[DataFrame], key: str, ts: str, tie: str, last) -> DataFrame:
    """For each day up to the one after ``last``, each key's last row before it."""
    rows = known[0]
    for more in known[1:]:
        rows = rows.unionByName(more.select(rows.columns))
    whole = F.struct(*[c for c in rows.columns if c != "day"])
    per_day = rows.groupBy(key, "day").agg(F.max_by(whole, F.struct(ts, tie)).alias("row"))
    by_day = Window.partitionBy(key).orderBy("day")
    until = F.coalesce(F.lead("day").over(by_day), F.date_add(F.lit(last), 1))
    days = F.sequence(F.date_add("day", 1), F.col("until"))
    spread = per_day.withColumn("until", until).select("row", F.explode(days).alias("day"))
    return spread.select("row.*", "day")


def _versions(spark: SparkSession, path: str, kind: str, below: int | None, like: DataFrame) -> DataFrame:
    schema = T.StructType([*like.schema.fields, T.StructField("version", T.LongType())])
    found = spark.read.schema(schema).parquet(_part(path, kind))
    return found if below is None else found.where(F.col("version") < below)


def _latest(carried: DataFrame, key: str) -> DataFrame:
    """Of the carried rows of a key and day those of the last version."""
    whole = F.struct(*[c for c in carried.columns if c not in (key, "day", "version")])
    one = carried.groupBy(key, "day").agg(F.max_by(whole, "version").alias("_row"))
    return one.select(key, "_row.*", "day")


def span(spark: SparkSession, path: str, version: int) -> tuple | None:
    """First and last day with an observation, up to a version; None if there is none."""
    row = spark.read.parquet(_part(path, "span", version)).first()
    return None if row is None or row["first_day"] is None else (row["first_day"], row["last_day"])


def in_days(probes: DataFrame, path: str, version: int, like: DataFrame, key: str, probe_ts: str, ts: str) -> DataFrame:
    """The observations that decide what held at the times of ``probes``, as a table like ``like``.

    Those are the observations of the probes' days and, just before each day, the one carried into
    it. Only these days' partitions are read; the days of a batch are few and are listed by the driver.
    """
    spark = probes.sparkSession
    extent = span(spark, path, version)
    names = like.columns
    if extent is None:
        return like.limit(0)
    after = F.date_add(F.lit(extent[1]), 1)
    # all days after the last one with an observation are as the first of them
    wanted = F.least(F.to_date(probe_ts), after)
    days = [r[0] for r in probes.where(F.col(probe_ts).isNotNull()).select(wanted.alias("day")).distinct().collect()]
    dated = like.withColumn("day", F.to_date(ts))
    here = F.col("day").isin(days) if days else F.lit(False)
    seen = _versions(spark, path, "observed", version + 1, dated).where(here).select(names)
    carried = _latest(_versions(spark, path, "carried", version + 1, dated).where(here), key)
    start = F.col("day").cast("timestamp") - F.make_dt_interval(secs=F.lit(0.000001))
    return seen.unionByName(carried.withColumn(ts, start).select(names))
