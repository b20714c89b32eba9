"""Consumption, stock movement and pharmacy transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.functions.columns import in_order, look_up, money, value
from wardbook.functions.moments import Moment, from_until, last_days, required, start_of_day
from wardbook.operators.stock import consumption, transfers
from wardbook.sources.catalog import Tables

# Defaults the reports are run with.
MAIN_STORE = "M"
DEFAULT_LOCATION = "101"
PHARMACIES = "%PHARM%"
IN_HOUSE_PHARMACY = "%FMH IN HOUSE%"
KPI_TRANSFER_START = "2025-01-01"
KPI_TRANSFER_END = "2025-02-01"


def consumption_analysis(
    tables: Tables, start: Moment, end: Moment, location: str
) -> DataFrame:
    """Consumption in [start, end) per store, cost centre, item and move type."""
    window = from_until(F.col("trans_date"), start, end)
    rows = (
        consumption(tables, window, required(location, "location"))
        .groupBy(
            "location_id",
            "move_type_id",
            "store_id",
            "store",
            "cost_centre_id",
            "sub_ldgr_item_desc",
            "item_id",
            "item",
        )
        .agg(money(F.sum("qty"), "qty"), value(F.sum("value"), "value"))
    )
    return in_order(rows, "store_id")


def stock_movement_daily(tables: Tables, start: Moment, end: Moment) -> DataFrame:
    """Quantities and values in and out of main stores per day, item and transaction type.

    The ledger is summed on its own codes first; store, item and type names
    are joined to the sums.
    """
    main = tables.store.where(F.col("main_sub") == MAIN_STORE).select(
        "store_id", F.col("description").alias("store")
    )
    price = F.col("moving_average_price")
    keys = ["store_id", "transaction_date", "item_id", "transaction_type_id"]
    summed = (
        tables.inventory_ledger.where(from_until(F.col("transaction_date"), start, end))
        .join(main.select("store_id"), "store_id", "left_semi")
        .withColumn("transaction_date", start_of_day(F.col("transaction_date")))
        .groupBy(*keys)
        .agg(
            F.sum("qty_debit").alias("qty_debit"),
            F.sum(F.col("qty_debit") * price).alias("debt_value"),
            F.sum("qty_credit").alias("qty_credit"),
            F.sum(F.col("qty_credit") * price).alias("credit_value"),
        )
    )
    types = tables.transaction_type.select("transaction_type_id", "description")
    named = summed.join(main, "store_id").join(types, "transaction_type_id")
    rows = (
        look_up(named, "item_id", tables.drug_label, "item")
        .groupBy("store_id", "store", *keys[1:3], "item", keys[3], "description")
        .agg(
            money(F.sum("qty_debit"), "qty_debit"),
            value(F.sum("debt_value"), "debt_value"),
            money(F.sum("qty_credit"), "qty_credit"),
            value(F.sum("credit_value"), "credit_value"),
        )
        .withColumn("balance", value(F.col("debt_value") - F.col("credit_value"), "balance"))
    )
    return in_order(rows, "transaction_date", "store")


def pharmacy_transfers(
    tables: Tables, start: Moment, end: Moment, from_store: str = PHARMACIES
) -> DataFrame:
    """Transfer lines approved in [start, end) out of matching stores, with their value."""
    rows = transfers(tables, start, end, from_store)
    rows = look_up(rows, "item_id", tables.item_label, "drug").select(
        "trans_no",
        "approved_date",
        "from_store",
        "to_store",
        "item_id",
        "drug",
        "transfered_qty",
        "value",
        "cancel_qty",
        "cancel",
    )
    return in_order(rows, "approved_date")


def kpi_consumption(
    tables: Tables, as_of: Moment | None = None, location: str = DEFAULT_LOCATION
) -> DataFrame:
    """Quantity and value consumed in the last 30 days."""
    recent = consumption(tables, last_days(F.col("trans_date"), as_of), location)
    return recent.agg(
        money(F.coalesce(F.sum("qty"), F.lit(0)), "consumption_qty"),
        value(F.coalesce(F.sum("value"), F.lit(0)), "consumption_value"),
    )


def kpi_pharmacy_consumption(
    tables: Tables,
    start: Moment = KPI_TRANSFER_START,
    end: Moment = KPI_TRANSFER_END,
    from_store: str = IN_HOUSE_PHARMACY,
) -> DataFrame:
    """Value transferred plus value cancelled; zero if either of the two is unknown."""
    both = F.sum("value") + F.sum("cancel")
    return transfers(tables, start, end, from_store).agg(
        value(F.coalesce(both, F.lit(0)), "total_con")
    )
