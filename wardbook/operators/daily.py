"""Rolling figures from one row a day: partial sums in folders that late rows replace.

A rolling window of 30 days is 30 rows, whatever the facts behind them weigh.
Each day is a partition of its own and is always written whole, so a day is
replaced, never added to, and writing it twice changes nothing.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardbook.functions.moments import Moment, literal, parse_moment
from wardbook.operators.donations import described_donations
from wardbook.operators.receipts import client_receipt_lines
from wardbook.operators.receivables import CLIENT_INVOICE_TYPES
from wardbook.operators.stock import consumption
from wardbook.sources.catalog import Tables

# Fixed value: the location figures are kept for unless told otherwise.
DEFAULT_LOCATION = "101"

FIGURES = ["client_receipts", "consumption", "debtor_billing", "donations"]
SCHEMA = "figure string, quantity decimal(28,2), amount decimal(38,6), day date"


def between(column: Column, start: datetime | None, end: datetime | None) -> Column:
    """Half-open window that may be open on either side; NULL is never in it."""
    inside = column.isNotNull()
    if start is not None:
        inside = inside & (column >= literal(start))
    return inside if end is None else inside & (column < literal(end))


def sums_by_day(
    tables: Tables,
    start: datetime | None,
    end: datetime | None,
    location: str = DEFAULT_LOCATION,
) -> DataFrame:
    """``figure, quantity, amount, day`` of every day in the window that has rows, from the facts themselves."""

    def within(column: str) -> Column:
        return between(F.col(column), start, end)

    def summed(name: str, rows: DataFrame, moment: str, amount: str, quantity: Column | None = None):
        return rows.groupBy(F.col(moment).cast("date").alias("day")).agg(
            F.lit(name).alias("figure"),
            (F.lit(None) if quantity is None else F.sum(quantity)).cast("decimal(28,2)").alias("quantity"),
            F.sum(amount).cast("decimal(38,6)").alias("amount"),
        )

    receipts = tables.cash_receive_master.where(within("receive_date"))
    gifts = tables.donation.where((F.col("receipt_location_id") == location) & within("trans_date"))
    invoices = tables.final_invoice_master.where(
        F.col("final_invoice_type").isin(CLIENT_INVOICE_TYPES) & within("final_invoice_date")
    )
    moved = consumption(tables, within("trans_date"), location, F.col("trans_date").cast("date").alias("moved_on"))
    parts = [
        summed("client_receipts", client_receipt_lines(tables, receipts), "receive_date", "gross_amount"),
        summed("consumption", moved, "moved_on", "value", F.col("qty")),
        summed("debtor_billing", invoices, "final_invoice_date", "net_receivable"),
        summed("donations", described_donations(tables, gifts), "trans_date", "amount"),
    ]
    first, *others = (part.select("figure", "quantity", "amount", "day") for part in parts)
    for other in others:
        first = first.unionByName(other)
    return first


def stored_days(spark: SparkSession, folder: str) -> DataFrame:
    """What was written so far; nothing where nothing was."""
    try:
        return spark.read.schema(SCHEMA).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def refresh_days(
    tables: Tables,
    folder: str,
    start: Moment | None = None,
    end: Moment | None = None,
    location: str = DEFAULT_LOCATION,
) -> None:
    """Write the days in ``[start, end)`` anew from the facts; days outside stay as they are.

    Late rows are taken in by writing their days again. A stored day that has no
    rows any more is written with none, as an absent one would keep its old sums.
    """
    first = None if start is None else parse_moment(start, "start")
    last = None if end is None else parse_moment(end, "end")
    for moment in (first, last):
        if moment is not None and moment != datetime(moment.year, moment.month, moment.day):
            raise ValueError(f"days are refreshed whole, so bounds are midnights, got {moment}")
    found = sums_by_day(tables, first, last, location)
    spark = found.sparkSession
    known = stored_days(spark, folder).where(between(F.col("day").cast("timestamp_ntz"), first, last))
    blank = known.select("day").distinct().select(
        F.lit(None).cast("string").alias("figure"),
        F.lit(None).cast("decimal(28,2)").alias("quantity"),
        F.lit(None).cast("decimal(38,6)").alias("amount"),
        "day",
    )
    (
        found.unionByName(blank)
        .repartition("day")
        .sortWithinPartitions("day", "figure")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(folder)
    )


def rolling_figures(
    tables: Tables,
    folder: str,
    as_of: Moment,
    days: int = 30,
    location: str = DEFAULT_LOCATION,
) -> DataFrame:
    """``figure, quantity, amount`` since ``days`` before ``as_of``, time of day included, open to the future.

    Whole days come from the folder, which only their partitions are read of. Where
    the window begins within a day, what is left of that day is summed from the facts.
    """
    since = parse_moment(as_of, "as_of") - timedelta(days=days)
    midnight = datetime(since.year, since.month, since.day)
    whole = midnight if since == midnight else midnight + timedelta(days=1)
    spark = tables.final_invoice_master.sparkSession
    parts = stored_days(spark, folder).where(
        F.col("figure").isNotNull() & (F.col("day") >= F.lit(whole.date()))
    )
    if whole != since:
        parts = parts.unionByName(sums_by_day(tables, since, whole, location))
    zeroes = spark.createDataFrame([(name,) for name in FIGURES], "figure string")
    return (
        zeroes.join(parts, "figure", "left")
        .groupBy("figure")
        .agg(
            F.when(F.col("figure") == "consumption", F.coalesce(F.sum("quantity"), F.lit(0)))
            .cast("decimal(28,2)")
            .alias("quantity"),
            F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(38,6)").alias("amount"),
        )
    )
