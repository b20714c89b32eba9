"""Exact distinct counts of numbered things that can be merged.

A distinct count cannot be added up: a number seen by two partial results counts
once. A set of bits can. Numbers are cut into runs of 32,768, and each run that a
group has seen is one bit set of 4 KB, mostly zeroes that compress away;
sets of equal runs merge by OR. So partial results of days, files or branches can be kept and
united later, and the numbers themselves are never shuffled as keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN, BITS = "number_run", "number_bits"


def numbered_partials(rows: DataFrame, group: Sequence[str], number: str, **sums: Column) -> DataFrame:
    """Per group and run of numbers: the bits of the numbers seen, and partial ``sums``.

    NULL numbers are in a run of their own without bits, so their rows still count in the sums.
    """
    return rows.groupBy(*group, F.bitmap_bucket_number(number).alias(RUN)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias(BITS),
        *(F.sum(column).alias(name) for name, column in sums.items()),
    )


def united_partials(partials: DataFrame, group: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Partials of several kinds, days or files, of equal group and run, as one."""
    return partials.groupBy(*group, RUN).agg(
        F.bitmap_or_agg(BITS).alias(BITS), *(F.sum(name).alias(name) for name in sums)
    )


def counted(partials: DataFrame, group: Sequence[str], count: str, sums: Sequence[str]) -> DataFrame:
    """Per group the exact number of distinct numbers, and the sums; runs must be united before."""
    bits = F.when(F.col(RUN).isNotNull(), F.bitmap_count(BITS)).otherwise(F.lit(0))
    return partials.groupBy(*group).agg(
        F.sum(bits).alias(count), *(F.sum(name).alias(name) for name in sums)
    )
