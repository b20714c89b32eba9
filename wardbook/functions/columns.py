"""Small column and frame helpers shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardbook.functions.joins import join_reduced


def or_zero(column: str) -> Column:
    """The column with NULL read as zero."""
    return F.coalesce(F.col(column), F.lit(0))


def money(column: Column, name: str) -> Column:
    """Fixed output type of every summed amount."""
    return column.cast("decimal(28,2)").alias(name)


def value(column: Column, name: str) -> Column:
    """Fixed output type of every quantity times unit cost."""
    return column.cast("decimal(38,6)").alias(name)


def in_order(frame: DataFrame, *keys: str) -> DataFrame:
    """Sort ascending with NULLs last.

    The remaining columns break ties, so the order is repeatable and a day
    that holds much of the data can still be cut into several sort ranges.
    """
    rest = [name for name in frame.columns if name not in keys]
    return frame.orderBy(*(F.col(name).asc_nulls_last() for name in [*keys, *rest]))


def look_up(rows: DataFrame, key: str, names: DataFrame, name: str) -> DataFrame:
    """Attach one label per key, NULL for an unknown key.

    ``names`` has the columns (key, label); should a key come with several
    labels the first in text order is taken, so no row is ever doubled.
    """
    names_key, label = names.columns
    single = names.groupBy(F.col(names_key).alias(key)).agg(F.min(label).alias(name))
    return join_reduced(rows, single, [key], "left")
