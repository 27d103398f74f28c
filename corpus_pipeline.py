"""From raw documents to packed training sequences, in five written stages.

Every stage works on all that the one before kept, and all but the last return
the columns of ``documents``:

1. quality classifier: documents scored below the threshold go;
2. n-gram Jaccard join: one document of each group of near duplicates (5-word shingles, 0.8) stays;
3. secret scans: every secret in a text gives way to a placeholder;
4. mixing: documents are there as often as the mix takes them;
5. packing: token pieces with their place in sequences of 4096.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from courierflow.llm import jaccard_join, mixing, packing, quality_classifier, queries, secret_scan
from courierflow.session import written

NEAR_WORDS = 5
NEAR_SIMILARITY = (4, 5)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.prepare(spark)
    return quality_classifier.keep_good(docs, queries.table(spark, sf_dir, "labels"), queries.learnable())


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.prepare(spark)
    return jaccard_join.keep_one(docs, words=NEAR_WORDS, similarity=NEAR_SIMILARITY)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.prepare(spark)
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.prepare(spark)
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.prepare(spark)
    return packing.pack_documents(docs, queries.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("mixing_sources", mix_sources),
    ("best_fit_packing", pack),
]

# SQL cannot express the classifier; tests compare the operators of the stages, and stage 2 itself, with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` in ``sf_dir``."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
