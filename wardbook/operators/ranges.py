"""Bounds on the numbers of documents, where these are given out in sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.functions.joins import within_range_of
from wardbook.sources.catalog import Tables
from wardbook.sources.clustered import ANY_MONTH, MONTH, month_of


def near(tables: Tables, rows: DataFrame, key: str, others: DataFrame) -> DataFrame:
    """Rows with a key, cut to the number range of ``others`` where numbers follow time.

    Then the documents of a date window lie close together, and the scan skips
    the files and row groups of other times instead of shuffling all of them.
    """
    if tables.numbers_follow_time:
        return within_range_of(rows, key, others, key)
    return rows.where(F.col(key).isNotNull())


def in_months_of(lines: DataFrame, headers: DataFrame, moment: str) -> DataFrame:
    """Lines of a layout by month that may belong to one of ``headers``: those of its months, and of any month.

    The months are a list of at most twelve a year, so it is safe to send to every task, and Spark asks it
    which folders to open before it plans the scan. Lines of another layout stay as they are.
    """
    if MONTH not in lines.columns:
        return lines
    months = headers.select(month_of(moment).alias(MONTH)).where(F.col(MONTH).isNotNull()).distinct()
    any_month = headers.sparkSession.range(1).select(F.lit(ANY_MONTH).alias(MONTH))
    return lines.join(F.broadcast(months.unionByName(any_month)), MONTH, "left_semi").drop(MONTH)
