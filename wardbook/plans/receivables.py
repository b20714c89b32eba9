"""Receivables, reference letters and client receipts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.functions.columns import in_order, look_up, money, or_zero
from wardbook.functions.moments import Moment, from_until, last_days
from wardbook.operators.ranges import near
from wardbook.operators.receipts import client_receipt_lines, unrefunded
from wardbook.operators.receivables import (
    CLIENT_INVOICE_TYPES,
    addressed_invoices,
    open_invoices,
    settled_invoices,
    unpaid_client_invoices,
    with_stay_details,
)
from wardbook.sources.catalog import Tables

# Defaults the reports are run with.
TICKED = "Y"
LETTER_CLIENT = "1012000041"
LETTER_ACCOUNT = "911010"
AGING_CUTOFF = "2016-01-01"
CARD_MODE = "001006"
EXCLUDED_CLIENT_WORDS = ("FUND", "NEPHRO", "HAMD")
MIN_UNADJUSTED = 50


def client_receipt_adjustment(tables: Tables) -> DataFrame:
    """Ticked receipt adjustments with client and patient names."""
    cheques = tables.franchise_cheque.select("final_receipt_no", "receive_no")
    ticked = tables.final_receipt_detail2.where(F.col("chk_option") == TICKED)
    receipts = tables.cash_receive_master.select(
        "receive_no", "client_id", F.col("total_amount").alias("cash_receive_amount"), "receive_date"
    )
    rows = ticked.join(cheques, "final_receipt_no").join(receipts, "receive_no")
    rows = look_up(rows, "client_id", tables.client.select("client_id", "name"), "client_name")
    rows = look_up(rows, "mrno", tables.v_patient.select("mrno", "name"), "patient_name")
    received = or_zero("received_amount")
    return rows.select(
        "client_id",
        "client_name",
        "patient_name",
        "mrno",
        F.col("invoice_amount").alias("bill_amount"),
        money(received, "received_amount"),
        money(F.col("invoice_amount") - received, "remaining_amount"),
        "adjusted_amount",
        "adjust_amount",
        "client_invoice_no",
        "final_receipt_no",
        "receive_no",
        "cash_receive_amount",
        "receive_date",
    )


def referral_letter_amounts(
    tables: Tables, client_id: str = LETTER_CLIENT, coa_code: str = LETTER_ACCOUNT
) -> DataFrame:
    """Amount per reference letter of one client and account.

    The ledger is summed per transaction before it meets the letters.  A NULL
    debit or credit takes its line out of the sum.
    """
    entry = ["client_id", "mrno", "trans_no", "admission_no", "ref_letter_no"]
    summed = (
        tables.pbs_tran_detail.where(
            (F.col("client_id") == client_id)
            & (F.col("coa_code") == coa_code)
            & F.col("ref_letter_no").isNotNull()
        )
        .groupBy(*entry)
        .agg(F.sum(F.col("dr_amount") - F.col("cr_amount")).alias("amount"))
    )
    letters = tables.ref_letter_master.select(
        "ref_letter_no",
        "client_ref_no",
        F.col("trans_date").alias("ref_letter_trans_date"),
        F.col("mrno").alias("letter_mrno"),
    )
    patients = tables.v_patient.select(F.col("mrno").alias("letter_mrno"), "name")
    clients = tables.client.select("client_id", F.col("name").alias("client_name"))
    group = [
        "client_id",
        "client_name",
        "mrno",
        "name",
        "trans_no",
        "admission_no",
        "ref_letter_no",
        "client_ref_no",
        "ref_letter_trans_date",
    ]
    amounts = (
        summed.join(clients, "client_id")
        .join(letters.join(patients, "letter_mrno"), "ref_letter_no")
        .groupBy(*group)
        .agg(money(F.sum("amount"), "amount"))
    )
    return in_order(amounts, "ref_letter_trans_date")


def debtor_aging_open(tables: Tables, cutoff: Moment = AGING_CUTOFF) -> DataFrame:
    """Open client invoices with letter and admission."""
    unpaid = unpaid_client_invoices(tables, cutoff)
    rows = with_stay_details(tables, open_invoices(tables, unpaid)).select(
        "client_id",
        "client_name",
        "process_id",
        "final_invoice_date",
        "client_invoice_no",
        "ref_letter_no",
        "mrno",
        "nic_new",
        "admission_no",
        "admission_date",
        "patient_name",
        "net_receivable",
        "received_amount",
        "remaining",
        "final_invoice_type",
        "final_invoice_no",
    )
    return in_order(rows, "client_id", "final_invoice_date")


def debtor_aging_settled(tables: Tables) -> DataFrame:
    """Settled client invoices of corporate processes with letter and admission."""
    rows = with_stay_details(tables, settled_invoices(tables)).select(
        "client_id",
        "client_name",
        "process_id",
        "final_invoice_date",
        "client_invoice_no",
        "ref_letter_no",
        "mrno",
        "nic_new",
        "admission_no",
        "admission_date",
        "patient_name",
        "net_receivable",
        "received_amount",
        "remaining",
    )
    return in_order(rows, "client_id", "final_invoice_date")


def client_receipts(tables: Tables, start: Moment, end: Moment) -> DataFrame:
    """Client receipts in [start, end) that were not refunded."""
    receipts = tables.cash_receive_master.where(from_until(F.col("receive_date"), start, end))
    rows = client_receipt_lines(tables, receipts).select(
        "receive_date",
        "received_by",
        "received_by_name",
        "receive_no",
        "payment_mode",
        "instrument_no",
        "net_amount",
        "wht_tax",
        "gross_amount",
        "client_id",
        "client",
        "final_invoice_no",
        "remarks",
    )
    return in_order(rows, "receive_date")


def client_unadjusted_receipts(
    tables: Tables,
    min_amount: int = MIN_UNADJUSTED,
    excluded: Sequence[str] = EXCLUDED_CLIENT_WORDS,
) -> DataFrame:
    """Receipt instruments with more than ``min_amount`` per line still to adjust."""
    named = F.col("name").isNotNull()
    for word in excluded:
        named = named & ~F.upper("name").contains(word.upper())
    clients = tables.client.where(named)
    unadjusted = or_zero("amount") + or_zero("wht_tax") - or_zero("received_amount")
    lines = tables.cash_receive_detail.select(
        "receive_no", "instrument_no", unadjusted.alias("unadjusted")
    ).where(F.col("unadjusted") > min_amount)
    receipts = tables.cash_receive_master.where(F.col("client_id").isNotNull()).select(
        "receive_no", "client_id", "receive_date"
    )
    rows = (
        unrefunded(tables, receipts)
        .join(lines, "receive_no")
        .join(clients, "client_id")
        .groupBy("client_id", "name", "receive_date", "receive_no", "instrument_no")
        .agg(money(F.sum("unadjusted"), "amount"))
    )
    return in_order(rows, "receive_date")


def card_receipts(
    tables: Tables, start: Moment, end: Moment, payment_mode: str = CARD_MODE
) -> DataFrame:
    """Card receipts in [start, end) with their merchant."""
    receipts = tables.cash_receive_master.where(
        from_until(F.col("receive_date"), start, end)
    ).select("receive_date", "sale_id", "invoice_no", "receive_no")
    lines = (
        near(tables, tables.cash_receive_detail, "receive_no", receipts)
        .where(F.col("payment_mode_id") == payment_mode)
        .select("receive_no", "amount", "instrument_no", "validity_date", "merchant_id")
    )
    rows = (
        receipts.join(lines, "receive_no")
        .join(tables.payment_mode_wise_merchant, "merchant_id")
        .select(
            "receive_date",
            "sale_id",
            "invoice_no",
            "receive_no",
            "amount",
            "description",
            "instrument_no",
            "validity_date",
        )
    )
    return in_order(rows, "receive_date")


def kpi_total_receivable(tables: Tables, cutoff: Moment = AGING_CUTOFF) -> DataFrame:
    """Sum remaining on all open client invoices."""
    total = F.coalesce(F.sum("remaining"), F.lit(0))
    unpaid = unpaid_client_invoices(tables, cutoff)
    addressed = addressed_invoices(tables, open_invoices(tables, unpaid))
    return addressed.agg(money(total, "total_receivable"))


def kpi_client_receipts(tables: Tables, as_of: Moment | None = None) -> DataFrame:
    """Gross client receipts of the last 30 days."""
    recent = tables.cash_receive_master.where(last_days(F.col("receive_date"), as_of))
    total = F.coalesce(F.sum("gross_amount"), F.lit(0))
    return client_receipt_lines(tables, recent).agg(money(total, "gross_amount"))


def kpi_debtor_billing(tables: Tables, as_of: Moment | None = None) -> DataFrame:
    """Net receivable of client invoices of the last 30 days."""
    recent = tables.final_invoice_master.where(
        F.col("final_invoice_type").isin(CLIENT_INVOICE_TYPES)
        & last_days(F.col("final_invoice_date"), as_of)
    )
    return recent.agg(money(F.coalesce(F.sum("net_receivable"), F.lit(0)), "billing"))
