from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
# names that operators use inside
CLASHING = ("size", "row", "key", "score", "rank", "target", "spans", "node", "copy", "range")
SENTENCE = "the quick brown fox jumps over the lazy dog while nine small birds look on from a tall old tree near the river "


@pytest.fixture
def documents(spark):
    def make(rows, clashing=False):
        """Documents of (doc_id, text) or (doc_id, text, lang, source) rows."""
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "a")), None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if clashing:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit("x").alias(c) for c in CLASHING])
        return df

    return make


@pytest.fixture
def odd_rows():
    """Null, empty, blank, very long and repeated texts, null ids, sources and languages."""
    long = "".join(f"word{i} " for i in range(30000))
    return [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \n\t ", "en", None),
        (4, long, "en", "a"),
        (5, SENTENCE * 3, "en", "b"),
        (6, SENTENCE * 3, "fr", "b"),
        (6, SENTENCE * 3, "fr", "b"),
        (7, "one", "fr", "c"),
        (8, "x" * 50000, None, "c"),
        (None, SENTENCE * 3, None, "a"),
        (None, None, None, None),
    ]
