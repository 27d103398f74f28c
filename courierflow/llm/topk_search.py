"""Exact search of the k nearest vectors by integer inner product.

Queries and candidates are cut into blocks of bounded size. Each tile (a block of
queries and a block of candidates) is one matrix product, of which only each
query's best k stay; these lists are merged in two levels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 10
SCALE = 1024.0
CANDIDATES = 16384  # mean rows of a block of candidates
QUERIES = 2048  # mean rows of a block of queries
ROWS = 128  # queries multiplied at once
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, vec, dim of the rows that take part: no null id, null vector, null or non-finite component."""
    v = F.col("vec")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vec"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull())
        .where(F.coalesce(finite, F.lit(False)))
        .withColumn("dim", F.size("vec"))
    )


def search(vectors: DataFrame, is_query, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query.

    ``is_query`` is a condition on vec_id. Components are floor(1024 * x); scores
    are exact, and are held at the ends of the 64-bit range beyond it. Ties go to the smaller vec_id. All rows
    of another vec_id are candidates, a repeated row as often as it stands
    there; of the rows that repeat a query's vec_id the smallest vector asks.
    Vectors are compared with those of their own length only. Rows with a null
    id, a null vector, or a null or non-finite component take no part; an empty
    table gives no rows; other columns are ignored.
    """
    rows = usable(vectors, id_column, vector_column)
    asked = rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))
    n, q = (max(1, x) for x in rows.agg(F.count(F.lit(1)), F.count_if(is_query(F.col("vec_id")))).first())
    shards, blocks = -(-n // CANDIDATES), -(-q // QUERIES)

    def part(column: str, parts: int):
        return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")

    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    right = rows.withColumn("shard", part("vec_id", shards)).withColumn("block", every_block)
    left = asked.withColumn("block", part("vec_id", blocks)).withColumn("shard", every_shard)
    # names and lineage of their own on either side of the cogroup
    left = left.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query"), *[F.col(c).alias(c) for c in ("dim", "shard", "block")])

    def tile(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        return _best(queries, candidates, k)

    keys = ["dim", "shard", "block"]
    partial = (
        left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, "query_id bigint, vec_id bigint, score bigint, shard int")
    )
    best = [F.col("score").desc(), F.col("vec_id")]
    fan = max(1, round(shards**0.5))
    groups = Window.partitionBy("query_id", F.col("shard") % fan).orderBy(*best)
    merged = partial.withColumn("rank", F.row_number().over(groups)).where(F.col("rank") <= k)
    final = Window.partitionBy("query_id").orderBy(*best)
    return merged.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(table: pa.Table, id_column: str, vector_column: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and floor(SCALE * x), whole numbers as doubles."""
    ids = table.column(id_column).to_numpy()
    flat = table.column(vector_column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    values = np.floor(SCALE * flat).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    return ids[order], values[order]


def _scores(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Inner products as integers: in doubles while every partial sum is exact there."""
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(a).reshape(a.shape) @ whole(b).reshape(b.shape).T
    return np.clip(exact, LOW, HIGH).astype(np.int64)


def _best(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    columns: list[list[np.ndarray]] = [[], [], []]
    if queries.num_rows and candidates.num_rows:
        query_ids, a = _matrix(queries, "query_id", "query")
        ids, b = _matrix(candidates, "vec_id", "vec")
        most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(1, a.shape[1])
        for at in range(0, len(query_ids), ROWS):
            scores = _scores(a[at : at + ROWS], b, most)
            for query, row in zip(query_ids[at : at + ROWS], scores):
                own = slice(np.searchsorted(ids, query, "left"), np.searchsorted(ids, query, "right"))
                others = np.delete(np.arange(len(ids)), own) if own.stop > own.start else np.arange(len(ids))
                values = row[others]
                if len(values) > k:
                    least = np.partition(values, len(values) - k)[len(values) - k]
                    others = others[values >= least]
                # ids ascend, so a stable sort leaves ties to the smaller one
                chosen = others[np.argsort(np.invert(row[others]), kind="stable")[:k]]
                columns[0].append(np.full(len(chosen), query))
                columns[1].append(ids[chosen])
                columns[2].append(row[chosen])
    shard = (candidates if candidates.num_rows else queries).column("shard")[0].as_py() if candidates.num_rows or queries.num_rows else 0
    arrays = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in columns]
    arrays.append(pa.array(np.full(len(arrays[0]), shard), pa.int32()))
    return pa.Table.from_arrays(arrays, ["query_id", "vec_id", "score", "shard"])
