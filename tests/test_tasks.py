"""Work whose cost is not in its bytes is dealt by its rows, however few files they come from."""

from __future__ import annotations

from pyspark.sql import functions as F

from courierflow.operators import geodata
from courierflow.plans import regression


def test_addresses_of_one_file_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(geodata, "ROWS_PER_TASK", 100)
    rows = spark.range(0, 1000, 1, 1).select("id", F.concat(F.lit("Shop "), "id", F.lit(" Main Road")).alias("address"))
    phrases = geodata.address_phrases(rows, ["id"], "address")
    assert phrases.rdd.getNumPartitions() == 10
    assert phrases.select("id").distinct().count() == 1000


def test_training_rows_of_one_file_use_all_cores(spark, monkeypatch):
    rows = spark.range(0, 1000, 1, 1)
    assert regression.spread(rows).rdd.getNumPartitions() == 1
    monkeypatch.setattr(regression, "ROWS_PER_TASK", 10)
    dealt = regression.spread(rows)
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r[0] for r in dealt.collect()) == list(range(1000))


def test_uneven_parts_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(regression, "ROWS_PER_TASK", 10)
    cores = spark.sparkContext.defaultParallelism
    even, uneven = spark.range(0, 1000, 1, cores), spark.range(0, 20, 1, cores - 1).union(spark.range(20, 1000, 1, 1))
    assert regression.spread(even) is even
    sizes = regression.spread(uneven).groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(sizes) == cores and sizes.max() < 200


def test_dispatch_orders_hold_no_hash_table_of_all_orders(tables, capsys):
    tables.dispatch_orders.select("id", "assigned_rider_id", "created_at").explain()
    joins = [line for line in capsys.readouterr().out.splitlines() if "Join [" in line and "o_orderkey" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
