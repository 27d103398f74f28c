"""Run a registered query and its SQL on the same folder and compare the rows."""

from __future__ import annotations

import math

import duckdb

from courierflow.sources.binding import BASE_TABLES

SMALL = "/root/testdata/sf0.001"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in BASE_TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 6) + 0.0
    return value


def _kind(value):
    return "number" if isinstance(value, (int, float)) and not isinstance(value, bool) else type(value).__name__


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows),
        key=lambda r: tuple((v is None, _kind(v), v if v is not None else 0) for v in r),
    )


def compare(spark_df, con, sql) -> str | None:
    """None if equal, else a short description of the first difference."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    wanted = _rows(names, cursor.fetchall())
    got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    kinds = {n: str(d[1]).upper() for n, d in zip(names, cursor.description)}
    expected = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "boolean": "BOOLEAN", "timestamp": "TIMESTAMP",
    }
    wrong = {n: (k, kinds[n]) for n, k in spark_df.dtypes if expected.get(k, k) not in kinds[n]}
    if wrong:
        return f"types {wrong}"
    if len(got) != len(wanted):
        return f"{len(got)} rows != {len(wanted)}"
    bad = [(g, w) for g, w in zip(got, wanted) if g != w]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None
