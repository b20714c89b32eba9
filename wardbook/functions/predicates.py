"""Row conditions with the NULL behaviour the reports depend on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardbook.functions.joins import join_reduced


def like_pattern(text: str) -> str:
    """A pattern whose only wildcards are ``%`` and ``_``; a backslash stands for itself."""
    return text.replace("\\", "\\\\")


def matches_if_given(column: Column, text: str | None) -> Column:
    """Case-blind "contains" filter that may be left out.

    Left out it still drops NULLs, because the unset filter is the pattern
    ``%``, which NULL does not match.
    """
    if not text:
        return column.isNotNull()
    return F.lower(column).like(like_pattern(f"%{text.lower()}%"))


def not_in(rows: DataFrame, key: str, listing: DataFrame) -> DataFrame:
    """Rows whose ``key`` is NOT IN the one-column ``listing``, with SQL's NULL rules.

    A NULL in the list empties the result, a NULL key is kept only against an
    empty list.  The list is never forced into a broadcast: it is anti-joined
    like any other table, and the two NULL rules need one row of counts, which
    is read as a scalar subquery.
    """
    (item,) = listing.columns
    listed = listing.select(F.col(item).alias(key))
    known_keys = listed.where(F.col(key).isNotNull()).distinct()
    kept = join_reduced(rows, known_keys, [key], "left_anti")
    entries, known = F.count(F.lit(1)), F.count(key)
    verdict = listed.agg(
        F.when(entries == 0, "all").when(entries > known, "none").otherwise("known keys").alias("v")
    ).scalar()
    return kept.where((verdict == "all") | ((verdict == "known keys") & F.col(key).isNotNull()))
