"""The figures of the front page, and account counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.functions.moments import Moment, last_days
from wardbook.operators.receivables import invoice_figures
from wardbook.plans.donations import kpi_donations
from wardbook.plans.receivables import AGING_CUTOFF, kpi_client_receipts
from wardbook.plans.stock import (
    KPI_TRANSFER_END,
    KPI_TRANSFER_START,
    kpi_consumption,
    kpi_pharmacy_consumption,
)
from wardbook.sources.catalog import Tables


def kpi_dashboard(
    tables: Tables,
    as_of: Moment | None = None,
    cutoff: Moment = AGING_CUTOFF,
    transfer_start: Moment = KPI_TRANSFER_START,
    transfer_end: Moment = KPI_TRANSFER_END,
) -> DataFrame:
    """All key figures as one row.

    Each figure is a scalar subquery, so Spark runs them side by side. The two
    consumption figures are fields of one, and so are the two of invoices, which
    come from one scan of them (``invoice_figures``); no other fact table has two.
    """
    billed = last_days(F.col("final_invoice_date"), as_of)
    invoiced = invoice_figures(tables, cutoff, billed).select(F.struct("total_receivable", "billing"))
    figures = {
        "client_receipts": kpi_client_receipts(tables, as_of),
        "donations": kpi_donations(tables, as_of),
        "pharmacy_consumption": kpi_pharmacy_consumption(tables, transfer_start, transfer_end),
    }
    consumed = kpi_consumption(tables, as_of).select(
        F.struct(
            F.col("consumption_qty").alias("quantity"), F.col("consumption_value").alias("value")
        )
    )
    one_row = consumed.sparkSession.range(1)
    return one_row.select(
        *(frame.scalar().alias(name) for name, frame in figures.items()),
        consumed.scalar().alias("consumed"),
        invoiced.scalar().alias("invoiced"),
    ).select(
        F.col("invoiced.total_receivable").alias("total_receivable"),
        F.col("consumed.quantity").alias("consumption_quantity"),
        F.col("consumed.value").alias("consumption_value"),
        "client_receipts",
        "donations",
        F.col("invoiced.billing").alias("total_debtor_billing"),
        "pharmacy_consumption",
    )


def user_account_counts(tables: Tables) -> DataFrame:
    """Accounts per patient number and full name."""
    return tables.users.groupBy("mrno", "full_name").agg(
        F.count(F.lit(1)).alias("user_count")
    )
