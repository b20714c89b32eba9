"""Cash receipts of clients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.functions.columns import or_zero
from wardbook.functions.predicates import not_in
from wardbook.operators.ranges import near
from wardbook.sources.catalog import Tables


def unrefunded(tables: Tables, receipts: DataFrame) -> DataFrame:
    """Receipts that no refund of a client names."""
    refunds = tables.cash_refund_master.where(F.col("client_id").isNotNull())
    return not_in(receipts, "receive_no", refunds.select("receipt_no"))


def client_receipt_lines(tables: Tables, receipts: DataFrame) -> DataFrame:
    """Lines of client receipts with payment mode, cashier and gross amount."""
    clients = tables.client.select("client_id", F.col("name").alias("client"))
    cashiers = tables.vu_information.select(
        F.col("mrno").alias("received_by"), F.col("name").alias("received_by_name")
    )
    modes = tables.payment_mode.select(
        "payment_mode_id", F.col("description").alias("payment_mode")
    )
    lines = near(tables, tables.cash_receive_detail, "receive_no", receipts).select(
        "receive_no",
        "payment_mode_id",
        "instrument_no",
        F.col("amount").alias("net_amount"),
        "wht_tax",
        (F.col("amount") + or_zero("wht_tax")).cast("decimal(28,2)").alias("gross_amount"),
        "final_invoice_no",
    )
    return (
        unrefunded(tables, receipts)
        .drop("invoice_no")
        .join(lines, "receive_no")
        .join(clients, "client_id")
        .join(cashiers, "received_by")
        .join(modes, "payment_mode_id")
    )
