from __future__ import annotations

import gzip
import os

from pyspark.sql import functions as F

from courierflow.operators import listing, mutations
from courierflow.session import work_path
from courierflow.sources import tables as T


def test_split_read_prunes_to_its_folder(spark, tables):
    from courierflow.operators.splitting import with_split

    path = work_path(spark, "split")
    T.write_split(with_split(tables.deliveries.select("order_id")), path)
    assert {d for d in os.listdir(path) if d.startswith("split=")} == {"split=train", "split=test"}
    plan = T.read_split(spark, path, "test")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_malformed_lines_are_set_aside(spark):
    path = work_path(spark, "csv")
    header = "order_id,distance_km,weather,traffic_level,time_of_day,vehicle_type,preparation_time_min,courier_experience_yrs,delivery_time_min"
    lines = [header, "1,5.2,Clear,Low,Morning,Bike,12.0,4.0,32.0", "2,far,Clear,Low,Morning,Bike,12.0,4.0,32.0"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    good, bad = T.read_delivery_csv(spark, path)
    assert [r["order_id"] for r in good.collect()] == [1]
    assert bad.first()["_corrupt_record"].startswith("2,far")
    # the same lines are bad whatever columns are asked for
    assert [r["order_id"] for r in good.select("order_id").collect()] == [1]
    assert (good.count(), bad.count()) == (1, 1)
    assert bad.select("_corrupt_record").first()[0].startswith("2,far")


def test_upload_keeps_text_of_cells_that_are_no_numbers(spark):
    path = work_path(spark, "upload")
    lines = ["Dist (km);Weather Type".replace(";", ","), "5.5,Clear", "unknown,Rainy"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    rows = T.read_upload(spark, path).orderBy("weather").collect()
    assert [(r["distance_km"], r["distance_km_text"], r["weather"]) for r in rows] == [
        (5.5, None, "Clear"), (None, "unknown", "Rainy"),
    ]


def test_uploads_with_different_headers(spark):
    path = work_path(spark, "up loads")
    sets = {
        "a": ["Dist (km),Weather Type,traffic_level", "5.5,Clear,Low"],
        "b": ["", "weather,traffic,distance_km", "Rainy,High,7", "Foggy,Low,far"],
        "c": ["weather,distance_km", "Snowy,1.5"],
    }
    for name, lines in sets.items():
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{path}/{name}")
    rows = T.read_upload(spark, f"{path}/*").orderBy("weather").collect()
    assert [(r["weather"], r["traffic_level"], r["distance_km"], r["distance_km_text"]) for r in rows] == [
        ("Clear", "Low", 5.5, None), ("Foggy", "Low", None, "far"), ("Rainy", "High", 7.0, None), ("Snowy", None, 1.5, None),
    ]


def test_heads_are_found_without_the_lines_behind_them(spark, tmp_path):
    (tmp_path / "one *.csv").write_text("\n  \nb,a\r\n1,2\n")
    (tmp_path / "two.csv").write_bytes(b"a,b\n" + b"\xff\xfe,2\n" * 10)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\n \n")
    with gzip.open(tmp_path / "three.csv.gz", "wt") as file:
        file.write("a,b\n5,6\n")
    found = T.files_by_header(spark, str(tmp_path))
    names = {head: sorted(f.rsplit("/", 1)[1] for f in files) for head, files in found.items()}
    assert names == {"b,a": ["one *.csv"], "a,b": ["three.csv.gz", "two.csv"]}
    plan = T.file_heads(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan and "text" not in plan


def test_history_line_quoting(spark):
    df = spark.createDataFrame(
        [(1, "2024", 'He said "hi"', 1.5, "Clear", "Low", "Night", "Car", 10.0, 2.0, 33.0, "Fast", "batch")],
        "id int, created_at string, destination_address string, distance_km double, weather string, traffic_level string, "
        "time_of_day string, vehicle_type string, prep_time_min double, courier_exp_yrs double, predicted_time_min double, "
        "risk_status string, source_type string",
    )
    line = T.history_lines(df).first()[0]
    assert line == '1,"2024","He said ""hi""",1.5,"Clear","Low","Night","Car",10.0,2.0,33.0,"Fast","batch"'
    assert T.history_header().startswith("ID,Time_Logged,Destination,")


def test_merge_keeps_blank_fields_and_deletes(spark):
    current = spark.createDataFrame([(1, "a", "k1"), (2, "b", "k2"), (3, "c", "k3")], "id int, name string, secret string")
    changes = spark.createDataFrame(
        [(1, "a2", "", False, 1), (1, "a3", "  ", False, 2), (2, None, None, True, 3), (4, "d", "k4", False, 4)],
        "id int, name string, secret string, deleted boolean, seq int",
    )
    merged = mutations.merge_snapshot(current, changes, "id", "seq", ("secret",))
    assert sorted(tuple(r) for r in merged.collect()) == [(1, "a3", "k1"), (3, "c", "k3"), (4, "d", "k4")]


def test_tenants_stay_apart(tables):
    log = tables.dispatch_orders
    recent = listing.recent(log, [F.desc("id")], 20, where=F.col("hotel_id") == 3)
    assert {r["hotel_id"] for r in recent.collect()} <= {3}
    assert mutations.clear_history(log, 3).where("hotel_id = 3").count() == 0
