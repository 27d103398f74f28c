"""Registered queries: SQL where there is some, and the pipeline stage by stage."""

from __future__ import annotations

import collections
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import corpus_pipeline  # noqa: E402
from __spark_entry__ import oracle_sql, queries  # noqa: E402
from oracle import compare  # noqa: E402

from courierflow.llm import queries as corpus  # noqa: E402
from courierflow.session import written  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "conversations", "labels", "benchmark"):
        con.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(corpus.SQL))
def test_matches_sql(spark, con, key):
    assert compare(queries()[key](spark, SMALL), con, oracle_sql()[key]) is None


def test_all_are_registered():
    keys = queries()
    assert all(any(k.startswith(f"op{n}_") for k in keys) for n in range(1, 14)) and "pipeline" in keys


def test_pipeline_stages(spark):
    docs = corpus.table(spark, SMALL, "documents")
    original = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL), name)
        if name != "best_fit_packing":
            assert docs.columns == columns
            kept[name] = docs.collect()
    ids = {name: {r["doc_id"] for r in rows} for name, rows in kept.items()}
    classified = queries()["op9_quality_classifier"](spark, SMALL).collect()
    assert ids["quality_classifier"] == {r["doc_id"] for r in classified if r["predicted"] == 1}
    assert ids["ngram_jaccard_join"] <= ids["quality_classifier"]
    assert ids["secret_scans"] == ids["ngram_jaccard_join"] and ids["mixing_sources"] <= ids["secret_scans"]
    assert len({original[i] for i in ids["ngram_jaccard_join"]}) == len(ids["ngram_jaccard_join"])
    copies = collections.Counter(r["doc_id"] for r in kept["mixing_sources"])
    packed = collections.Counter(r["doc_id"] for r in docs.where("piece = 0").collect())
    assert copies == packed
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
