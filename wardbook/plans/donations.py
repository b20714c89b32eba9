"""Donation lists and receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.functions.columns import in_order, money
from wardbook.functions.moments import Moment, from_through, last_days, now_or, required
from wardbook.operators.donations import described_donations
from wardbook.sources.catalog import Tables

# Fixed value: the location reports are run for unless told otherwise.
DEFAULT_LOCATION = "101"


def _at(tables: Tables, location: str) -> DataFrame:
    return tables.donation.where(F.col("receipt_location_id") == required(location, "location"))


def _printed(tables: Tables, donations: DataFrame, as_of: Moment | None) -> DataFrame:
    return described_donations(tables, donations).select(
        "receipt_no",
        "receipt_location_id",
        F.col("trans_date").alias("receipt_date"),
        "coa_code_cr",
        "party_name",
        "address",
        "on_account_of",
        "mode_of_payment",
        "cheque_no",
        "amount",
        "remarks",
        F.col("received_by").alias("cashier"),
        now_or(as_of).alias("printed_on"),
        "mobile",
    )


def donations_by_location(
    tables: Tables, start: Moment, end: Moment, location: str, as_of: Moment | None = None
) -> DataFrame:
    """Donations received at a location from ``start`` through ``end``, by date."""
    return in_order(donations_report(tables, start, end, location, as_of), "receipt_date")


def donations_report(
    tables: Tables,
    start: Moment,
    end: Moment,
    location: str = DEFAULT_LOCATION,
    as_of: Moment | None = None,
) -> DataFrame:
    """Donations received from ``start`` through ``end``, in no order."""
    received = _at(tables, location).where(from_through(F.col("trans_date"), start, end))
    return _printed(tables, received, as_of)


def donation_receipt(
    tables: Tables,
    receipt_no: int,
    location: str = DEFAULT_LOCATION,
    as_of: Moment | None = None,
) -> DataFrame:
    """One donation receipt; no number gives no rows."""
    one = _at(tables, location).where(F.col("receipt_no") == F.lit(receipt_no).cast("bigint"))
    return _printed(tables, one, as_of)


def donation_receipt_numbers(tables: Tables, location: str = DEFAULT_LOCATION) -> DataFrame:
    """Receipt number and party of every donation at a location, repeats kept."""
    return described_donations(tables, _at(tables, location)).select("receipt_no", "party_name")


def kpi_donations(
    tables: Tables, as_of: Moment | None = None, location: str = DEFAULT_LOCATION
) -> DataFrame:
    """Amount donated in the last 30 days."""
    recent = _at(tables, location).where(last_days(F.col("trans_date"), as_of))
    total = F.coalesce(F.sum("amount"), F.lit(0))
    return described_donations(tables, recent).agg(money(total, "donation_amount"))
