"""Ledger vouchers and opening balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardbook.functions.intervals import within_intervals
from wardbook.functions.moments import Moment, from_until, start_of_day
from wardbook.functions.predicates import like_pattern
from wardbook.operators.ranges import near
from wardbook.sources.catalog import Tables

# Statuses of posted vouchers.
POSTED = ["P", "T"]

VOUCHER = ["voucher_type", "voucher_no"]
SUB_LEDGER = ["ledger_type_code", "sub_ldgr_item_code"]


def code_starts(prefix: str) -> Column:
    """Accounts under a code prefix; ``%`` and ``_`` in it stay wildcards."""
    return F.col("coa_code").like(like_pattern(prefix) + "%")


def accounts(tables: Tables) -> DataFrame:
    return tables.gl_coa.select("coa_code", "coa_description")


def sub_ledgers(tables: Tables) -> DataFrame:
    return tables.gl_sub_ledgers.select(*SUB_LEDGER, "sub_ldgr_item_desc")


def voucher_lines(
    tables: Tables,
    masters: DataFrame,
    details: DataFrame,
    start: Moment,
    end: Moment,
    sub_ledger_join: str,
) -> DataFrame:
    """Lines of vouchers posted in [start, end) with account and sub-ledger names.

    A bound on the numbers covers all voucher types at once; the join tells them apart.
    """
    posted = masters.where(
        from_until(F.col("trans_date"), start, end) & F.col("voucher_status").isin(POSTED)
    ).select(
        *VOUCHER,
        "trans_date",
        F.col("reference_no").alias("cheque_no"),
        F.col("remarks").alias("voucher_remarks"),
    )
    return (
        near(tables, details, "voucher_no", posted)
        .drop("trans_date")
        .join(posted, VOUCHER)
        .join(accounts(tables), "coa_code")
        .join(sub_ledgers(tables), SUB_LEDGER, sub_ledger_join)
        .select(
            *VOUCHER,
            "trans_date",
            "cheque_no",
            "voucher_remarks",
            "coa_code",
            "coa_description",
            *SUB_LEDGER,
            "sub_ldgr_item_desc",
            "narration",
            "dr_amount",
            "cr_amount",
        )
    )


def daily_movements(tables: Tables, coa_code: str, year_code: str) -> DataFrame:
    """Debit and credit per sub-ledger and day of one account within a fiscal year's span.

    The span is read from the one-year calendar as scalar subqueries, which
    Spark evaluates first and hands to the scan, so other years' files are
    skipped.  A day belongs to the span if its midnight lies in it.
    """
    day = F.expr("interval 1 day")
    opens, closes = start_of_day(F.col("from_date")), start_of_day(F.col("to_date"))
    year = tables.gl_financial_year.where(F.col("year_code") == year_code)
    first = F.when(F.col("from_date") > opens, opens + day).otherwise(opens)
    since = year.agg(F.min(first)).scalar()
    before = year.agg(F.max(closes + day)).scalar()
    return (
        tables.gl_tran_detail.where(
            (F.col("coa_code") == coa_code)
            & (F.col("trans_date") >= since)
            & (F.col("trans_date") < before)
        )
        .groupBy("coa_code", *SUB_LEDGER, start_of_day(F.col("trans_date")).alias("day"))
        .agg(F.sum("dr_amount").alias("dr_amount"), F.sum("cr_amount").alias("cr_amount"))
    )


def movements_in_years(tables: Tables, coa_code: str) -> DataFrame:
    """Debit and credit per sub-ledger and day of one account, once for each fiscal year the day's midnight lies in.

    Years may overlap or leave gaps. Lines are summed by day before they meet the calendar.
    """
    years = tables.gl_financial_year.select("year_code", "from_date", "to_date")
    by_day = (
        tables.gl_tran_detail.where(F.col("coa_code") == coa_code)
        .groupBy("coa_code", *SUB_LEDGER, start_of_day(F.col("trans_date")).alias("day"))
        .agg(F.sum("dr_amount").alias("dr_amount"), F.sum("cr_amount").alias("cr_amount"))
    )
    return within_intervals(by_day, "day", years, "from_date", "to_date").drop("from_date", "to_date")


def opening_balances(tables: Tables, coa_code: str, year_code: str) -> DataFrame:
    """Opening balance per sub-ledger of one account, with the dates of its fiscal year."""
    years = tables.gl_financial_year.select("year_code", "from_date", "to_date")
    return (
        tables.gl_opening_balances.where(
            (F.col("year_code") == year_code) & (F.col("coa_code") == coa_code)
        )
        .join(years, "year_code")
        .select(
            "coa_code",
            *SUB_LEDGER,
            (F.col("open_dr") - F.col("open_cr")).cast("decimal(28,2)").alias("opening_balance"),
            "from_date",
            "to_date",
        )
    )
