"""Joins of moments with the intervals they fall in, without comparing every pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEVEL, _BIN = "__level", "__bin"


def day_number(moment: Column) -> Column:
    """Days since 1970 of a moment's date."""
    return F.unix_date(moment.cast("date"))


def bin_of(day: Column) -> Column:
    """The bin of a day among bins of 2^level days; the shift keeps days before 1970 in order."""
    return F.call_function("shiftright", day, F.col(_LEVEL))


def within_intervals(
    points: DataFrame, moment: str, intervals: DataFrame, begin: str, end: str
) -> DataFrame:
    """Rows of ``points`` with each row of ``intervals`` that has ``begin <= moment <= end``; the rest meets nothing.

    An interval of up to 2^k days lies in two bins of that width at most, so it is
    listed twice at most, and a point once for each width that some interval
    has: a fiscal calendar has one or two, and there are never over 24. The
    join is an equality of width and bin with the bounds beside it, which Spark can
    hash, broadcast by measured size, and split where one bin is crowded.
    """
    shared = set(points.columns) & set(intervals.columns)
    if shared:
        raise ValueError(f"columns of the same name on both sides: {sorted(shared)}")
    first, last = day_number(F.col(begin)), day_number(F.col(end))
    length = last - first
    listed = (
        intervals.where(F.col(begin) <= F.col(end))
        .withColumn(_LEVEL, F.when(length == 0, F.lit(0)).otherwise(F.length(F.bin(length))))
        .withColumn(_BIN, F.explode(F.sequence(bin_of(first), bin_of(last))))
    )
    levels = listed.agg(F.array_sort(F.collect_set(_LEVEL)).alias("levels")).scalar()
    placed = (
        points.where(F.col(moment).isNotNull())
        .withColumn(_LEVEL, F.explode(levels))
        .withColumn(_BIN, bin_of(day_number(F.col(moment))))
    )
    return (
        placed.join(listed, [_LEVEL, _BIN])
        .where(F.col(moment).between(F.col(begin), F.col(end)))
        .drop(_LEVEL, _BIN)
    )
