"""Billing documents and their lines as tables laid out for the reports that join them.

Lines carry no date of their own, so a report on a month has to read all of
them, unless they are stored by the month of their document. The writer adds that month and
makes one table for each of the four: a folder a month, and within it files by
bucket of the document number. A join on that number then moves no line,
and months that no document of a report lies in are not opened.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardbook.sources.catalog import Tables
from wardbook.sources.schemas import SCHEMAS

MONTH = "doc_month"
ANY_MONTH = date(1000, 1, 1)
"""The month of lines that belong to documents of several months or of none."""

# Header tables, their lines, the number that joins the two, and the date of the document.
DOCUMENTS = (
    ("invoice_master", "invoice_master_bill_dist", "invoice_no", "invoice_date"),
    ("return_master", "return_master_bill_dist", "return_no", "return_date"),
)


def month_of(moment: str) -> Column:
    return F.trunc(F.col(moment).cast("date"), "month")


def line_months(headers: DataFrame, number: str, moment: str) -> DataFrame:
    """One month for each document number, ``ANY_MONTH`` where its headers are of several months or have no date."""
    month = month_of(moment)
    same = (F.min(month) == F.max(month)) & (F.count(F.lit(1)) == F.count(month))
    one = F.when(same, F.max(month)).otherwise(F.lit(ANY_MONTH))
    return headers.where(F.col(number).isNotNull()).groupBy(number).agg(one.alias(MONTH))


def write_clustered(tables: Tables, database: str, buckets: int, root: str | None = None) -> None:
    """Write headers and lines of invoices and returns into ``database``, replacing what is there.

    ``buckets`` should make a bucket of a busy month about as large as a task
    may read at once. Lines of a number without a header, or whose headers lie in different months, go to
    ``ANY_MONTH``, which every report reads, so no line is ever missed. ``root`` is a
    folder for the files; without it they are where the metastore puts them.
    """
    for header, lines, number, moment in DOCUMENTS:
        headers = tables[header]
        months = line_months(headers, number, moment)
        stored = {
            header: (headers.withColumn(MONTH, month_of(moment)), moment),
            lines: (
                tables[lines]
                .join(months, number, "left")
                .withColumn(MONTH, F.coalesce(MONTH, F.lit(ANY_MONTH))),
                number,
            ),
        }
        for name, (rows, order) in stored.items():
            # Dealt out by the hash that buckets are made by, a task writes one bucket: one file a month.
            writer = (
                rows.select(*SCHEMAS_OF[name], MONTH)
                .repartition(buckets, number)
                .write.mode("overwrite")
                .partitionBy(MONTH)
                .bucketBy(buckets, number)
                .sortBy(order)
            )
            if root:
                writer = writer.option("path", f"{root}/{name}")
            writer.saveAsTable(f"{database}.{name}")


SCHEMAS_OF = {
    name: [column.split(" ")[0] for column in SCHEMAS[name].split(", ")]
    for pair in DOCUMENTS
    for name in pair[:2]
}


def clustered_tables(spark: SparkSession, database: str, others: Tables) -> Tables:
    """A catalog that takes billing documents and their lines from ``database``, and the rest from ``others``."""
    clustered = Tables(
        lambda name: spark.table(f"{database}.{name}") if name in SCHEMAS_OF else others[name],
        extra={lines: [(MONTH, "date")] for _, lines, _, _ in DOCUMENTS},
    )
    clustered.numbers_follow_time = others.numbers_follow_time
    return clustered
