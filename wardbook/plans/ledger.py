"""General ledger, provident fund, trial balances and corporate billing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.functions.columns import in_order, money
from wardbook.functions.moments import Moment, required
from wardbook.functions.predicates import matches_if_given
from wardbook.operators.vouchers import (
    SUB_LEDGER,
    accounts,
    code_starts,
    daily_movements,
    movements_in_years,
    opening_balances,
    sub_ledgers,
    voucher_lines,
)
from wardbook.sources.catalog import Tables

# Defaults the reports are run with.
FUND_PREFIX = "8"
CORPORATE_ACCOUNT = "1113116004"
ACCOUNT_LEVEL = "4"


def trial_balance_by_user(tables: Tables, mrno: int) -> DataFrame:
    """Trial balance rows prepared for a user's terminal, with anything but zeroes in them."""
    users = tables.users.where(F.col("mrno") == required(mrno, "mrno")).select(
        F.col("userid").alias("user_id"), "terminal", "mrno"
    )
    opened = (F.col("year_open_dr") != 0) | (F.col("year_open_cr") != 0)
    running = (F.col("run_open_dr") != 0) | (F.col("run_open_cr") != 0)
    moved = (F.col("tran_dr") != 0) | (F.col("tran_cr") != 0)
    return (
        tables.gl_trial_sub_ledgers.where(opened | running | moved)
        .join(users, ["user_id", "terminal"])
        .select(
            "coa_code",
            "coa_description",
            *SUB_LEDGER,
            "sub_ledger_item_desc",
            "run_open_dr",
            "run_open_cr",
            "tran_dr",
            "tran_cr",
            "close_dr",
            "close_cr",
            "user_id",
            "terminal",
            "mrno",
        )
    )


def account_codes(tables: Tables, level: str = ACCOUNT_LEVEL) -> DataFrame:
    """Accounts of a level whose ledger type has sub-ledgers."""
    in_use = tables.gl_sub_ledgers.select("ledger_type_code").distinct()
    rows = (
        tables.gl_coa.where(F.col("coa_level_code") == level)
        .join(in_use, "ledger_type_code", "left_semi")
        .select("coa_code", "coa_description")
        .distinct()
    )
    return in_order(rows, "coa_code")


def general_ledger(
    tables: Tables, start: Moment, end: Moment, coa_prefix: str, coa_from: str, coa_to: str
) -> DataFrame:
    """Posted voucher lines in [start, end) under a code prefix and within a code range, as texts."""
    wanted = code_starts(required(coa_prefix, "coa_prefix")) & F.col("coa_code").between(
        required(coa_from, "coa_from"), required(coa_to, "coa_to")
    )
    rows = voucher_lines(
        tables, tables.gl_tran_master, tables.gl_tran_detail.where(wanted), start, end, "left"
    )
    return in_order(rows, "trans_date", "voucher_type", "voucher_no")


def fund_general_ledger(
    tables: Tables, start: Moment, end: Moment, coa_prefix: str = FUND_PREFIX
) -> DataFrame:
    """Provident fund voucher lines in [start, end); lines without a known sub-ledger are left out."""
    details = tables.pf_tran_detail.where(code_starts(coa_prefix))
    rows = voucher_lines(tables, tables.pf_tran_master, details, start, end, "inner")
    return in_order(rows, "trans_date", "voucher_type", "voucher_no")


def fund_trial_balance(tables: Tables, year: str, coa_prefix: str = FUND_PREFIX) -> DataFrame:
    """Opening, movement and closing per account and sub-ledger of a fiscal year.

    The closing balance is summed row by row, so a NULL amount takes its row out.
    """
    closing = F.col("open_dr") - F.col("open_cr") + F.col("tran_dr") - F.col("tran_cr")
    measures = ["open_dr", "open_cr", "tran_dr", "tran_cr", "closing"]
    summed = (
        tables.gl_opening_balances.where(
            (F.col("year_code") == required(year, "year")) & code_starts(coa_prefix)
        )
        .withColumn("closing", closing)
        .groupBy("coa_code", *SUB_LEDGER)
        .agg(*(F.sum(name).alias(name) for name in measures))
    )
    rows = (
        summed.join(sub_ledgers(tables), SUB_LEDGER)
        .join(accounts(tables), "coa_code")
        .groupBy("coa_code", "coa_description", "sub_ldgr_item_code", "sub_ldgr_item_desc")
        .agg(*(money(F.sum(name), name) for name in measures))
    )
    return in_order(rows, "coa_code", "coa_description")


def corporate_billing_monthly(
    tables: Tables, year: str, client: str | None = None, coa_code: str = CORPORATE_ACCOUNT
) -> DataFrame:
    """Billing and receipts of the corporate account per sub-ledger and month of a fiscal year."""
    required(year, "year")
    clients = sub_ledgers(tables).where(matches_if_given(F.col("sub_ldgr_item_desc"), client))
    rows = (
        daily_movements(tables, coa_code, year)
        .join(opening_balances(tables, coa_code, year), ["coa_code", *SUB_LEDGER])
        .where(F.col("day").between(F.col("from_date"), F.col("to_date")))
        .join(accounts(tables), "coa_code")
        .join(clients, SUB_LEDGER)
        .groupBy(
            F.date_format("day", "MM-yyyy").alias("month"),
            "coa_code",
            "coa_description",
            *SUB_LEDGER,
            "sub_ldgr_item_desc",
            "opening_balance",
        )
        .agg(money(F.sum("dr_amount"), "billing"), money(F.sum("cr_amount"), "receipt"))
        .select(
            "month",
            "coa_code",
            "coa_description",
            F.col("sub_ldgr_item_code").alias("subsidiary_code"),
            F.col("sub_ldgr_item_desc").alias("client"),
            "opening_balance",
            "billing",
            "receipt",
        )
    )
    return in_order(rows, "subsidiary_code")


def corporate_billing_all_years(
    tables: Tables, client: str | None = None, coa_code: str = CORPORATE_ACCOUNT
) -> DataFrame:
    """Billing and receipts of the corporate account per sub-ledger and month of every fiscal year at once.

    A sub-ledger counts in the years that it has an opening balance in.
    """
    clients = sub_ledgers(tables).where(matches_if_given(F.col("sub_ldgr_item_desc"), client))
    opened = tables.gl_opening_balances.where(F.col("coa_code") == coa_code).select(
        "year_code",
        "coa_code",
        *SUB_LEDGER,
        (F.col("open_dr") - F.col("open_cr")).cast("decimal(28,2)").alias("opening_balance"),
    )
    rows = (
        movements_in_years(tables, coa_code)
        .groupBy("year_code", F.date_format("day", "MM-yyyy").alias("month"), "coa_code", *SUB_LEDGER)
        .agg(F.sum("dr_amount").alias("dr_amount"), F.sum("cr_amount").alias("cr_amount"))
        .join(opened, ["year_code", "coa_code", *SUB_LEDGER])
        .join(accounts(tables), "coa_code")
        .join(clients, SUB_LEDGER)
        .groupBy(
            "year_code",
            "month",
            "coa_code",
            "coa_description",
            *SUB_LEDGER,
            "sub_ldgr_item_desc",
            "opening_balance",
        )
        .agg(money(F.sum("dr_amount"), "billing"), money(F.sum("cr_amount"), "receipt"))
        .select(
            "year_code",
            "month",
            "coa_code",
            "coa_description",
            F.col("sub_ldgr_item_code").alias("subsidiary_code"),
            F.col("sub_ldgr_item_desc").alias("client"),
            "opening_balance",
            "billing",
            "receipt",
        )
    )
    return in_order(rows, "year_code", "subsidiary_code")
