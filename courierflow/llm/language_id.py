"""Language identification by compression.

Each language has a raw-content dictionary of sampled text. A text is encoded
with every dictionary, and the language whose encoding is smallest wins; a
narrow margin marks the decision as rejected.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SNIPPETS = 300  # sampled documents a language, each with one stretch of SNIPPET code points
SNIPPET = 400
LEVEL = 9
CHUNK = 2048  # bytes encoded at once, so that the dictionary counts throughout a long text
NARROW = 0.005  # least margin, as a share of the second smallest size
UNKNOWN = "und"


def snippets(docs: DataFrame, learn: Column) -> DataFrame:
    """lang, snippet: SNIPPETS sampled stretches of text per language, from the rows where ``learn`` holds.

    The sample is by digest of doc_id. Each task keeps at most SNIPPETS rows a
    language before anything is moved.
    """
    digest = F.xxhash64(F.col("doc_id").cast("string"))
    room = F.greatest(F.length("text") - SNIPPET, F.lit(0)) + 1
    rows = docs.where(learn & F.col("lang").isNotNull() & (F.length("text") > 0)).select(
        F.col("lang").cast("string").alias("lang"),
        digest.alias("digest"),
        F.substr("text", (F.pmod(digest, room) + 1).cast("int"), F.lit(SNIPPET)).alias("snippet"),
    )
    order = Window.partitionBy("lang").orderBy("digest", "snippet")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SNIPPETS).select("lang", "place", "snippet")


def dictionaries(docs: DataFrame, learn: Column) -> dict[str, bytes]:
    """One dictionary per language; its size is bounded by SNIPPETS and SNIPPET."""
    parts: dict[str, list[str]] = {}
    for r in snippets(docs, learn).orderBy("lang", "place").collect():
        parts.setdefault(r["lang"], []).append(r["snippet"])
    # what stands last in a dictionary is the cheapest to refer to
    return {lang: folded("\n".join(rows)) for lang, rows in parts.items()}


def folded(text: str) -> bytes:
    """What is encoded: the lower-cased text, since capitals would match nothing."""
    return text.lower().encode("utf-8", "surrogatepass")


class Encoders:
    """A prepared compressor per language; lengths of whole texts under each."""

    def __init__(self, contents: dict[str, bytes]):
        self.langs = sorted(contents)
        self.compressors = []
        for lang in self.langs:
            held = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)
            )

    def sizes(self, text: str) -> list[int]:
        raw = folded(text)
        parts = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, margin (0 to 1) and whether the margin is too narrow."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        second = sizes[order[1]] if len(order) > 1 else max(sizes[order[0]], len(folded(text)))
        margin = (second - sizes[order[0]]) / second
        return self.langs[order[0]], margin, margin < NARROW


def identify(docs: DataFrame, learn: Column, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the margin) and rejected of every row of ``docs`` (doc_id, text, lang).

    Only text and non-null lang of rows where ``learn`` holds are learned from;
    a prediction sees the text alone, all of it. A text that is null or has no
    letter, or any text if there is nothing to learn from, is UNKNOWN with score
    0. With one language the margin is against the plain text. Repeated rows are
    predicted each for itself; an empty table gives no rows; other columns are
    ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(dictionaries(docs, learn))

    def predict(batches):
        encoders = Encoders(held.value)
        for batch in batches:
            rows = [encoders.predict(text.as_py()) for text in batch.column(2)]
            langs, scores, rejected = list(zip(*rows)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), held_out.alias("held_out"), "text").mapInArrow(
        predict, "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean"
    )
