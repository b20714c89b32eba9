"""Joins that stay divisible when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_APART = "__apart"


def join_reduced(
    rows: DataFrame, reduced: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join rows with a side that was grouped or made distinct on the same keys.

    Spark would keep the partitioning of the grouping for such a join, and
    adaptive execution splits a hot key only where both sides of a join come
    straight out of a shuffle.  A hash of the keys as one more join key asks
    for that shuffle; the reduced side is the small one to move, and if it is
    small enough it is still broadcast once its size is known.
    """
    ours, theirs = dict(rows.dtypes), dict(reduced.dtypes)
    differing = [key for key in keys if ours[key] != theirs[key]]
    if differing:
        raise TypeError(f"join keys differ in type: {differing}")
    apart = F.xxhash64(*keys)
    return (
        rows.withColumn(_APART, apart)
        .join(reduced.withColumn(_APART, apart), [*keys, _APART], how)
        .drop(_APART)
    )


def aggregates_for(
    rows: DataFrame, source: DataFrame, keys: Sequence[str], *aggregates: Column
) -> DataFrame:
    """Aggregates of ``source`` for the keys that ``rows`` have: one row per key.

    What a correlated aggregate subquery asks for. The distinct keys of the rows
    are a semi join below the grouping, so of a large source only what belongs
    to some row is shuffled and grouped. A NULL in a key meets nothing.
    """
    wanted = rows.select(*keys).dropna().distinct()
    return join_reduced(source, wanted, keys, "left_semi").groupBy(*keys).agg(*aggregates)


def within_range_of(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """Drop rows whose key lies outside the smallest and largest key of ``others``.

    Meant for rows that are about to be joined to ``others`` on that key, where
    it changes nothing but the number of rows read and shuffled.  The bounds
    are one row, read as a scalar subquery before the scan starts.
    """
    bounds = others.agg(
        F.struct(F.min(other_key).alias("low"), F.max(other_key).alias("high"))
    ).scalar()
    return rows.where(F.col(key).between(bounds["low"], bounds["high"]))
