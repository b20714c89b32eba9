"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.llm.support import written


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)
        ).first()
    )


def components(links: DataFrame) -> DataFrame:
    """``(id, component_id)`` of every id in the links ``(a, b)``; the component's id is its smallest member.

    Each round moves every neighbour above a vertex to the smallest vertex around
    it (large star), then the ones below (small star); the number of rounds grows
    with the logarithm of the longest path. Minima are combined before each
    shuffle, and the joins that bring them back are plain equi-joins, which
    adaptive execution splits at hot vertices. Links with a null end are ignored.
    """
    edges = written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = _fingerprint(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (
            both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        )
        below = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(below, "a")
            .select(F.explode(F.array(F.struct("b", "low"), F.struct(F.col("a").alias("b"), "low"))).alias("e"))
            .select(F.col("e.b").alias("a"), F.col("e.low").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        edges = written(small)
        after = _fingerprint(edges)
        if after == state:
            break
        state = after
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(
        edges.select("b", "b").distinct()
    )
