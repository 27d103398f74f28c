"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierflow.session import written


def components(links: DataFrame) -> DataFrame:
    """(node, root): each linked node with the smallest node it can reach.

    ``links`` has the columns a and b. Alternates two steps until the links no
    longer change: every node hands the smallest of its neighbours to its larger
    neighbours, then to its smaller ones. Both are one partial minimum per node
    and one join, so a node with very many links is never gathered in one place.
    Each round is a written table. The smallest nodes themselves have no row.
    """
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = written(large, "links")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            low.select("a", F.col("low").alias("b"))
        )
        edges = written(small.where("a <> b").distinct(), "links")
        now = _state(edges)
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def _state(edges: DataFrame) -> tuple:
    digest = F.xxhash64("a", "b").cast("decimal(20,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(digest), F.sum("b")).first())
