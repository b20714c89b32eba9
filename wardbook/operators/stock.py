"""Stock movements and transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardbook.functions.columns import or_zero
from wardbook.functions.moments import Moment, from_until
from wardbook.functions.predicates import like_pattern, not_in
from wardbook.operators.ranges import near
from wardbook.sources.catalog import Tables

# Consumption move types, the store left out, the ledger type of
# cost centres and the transaction type of store transfers.
CONSUMPTION_MOVES = ["16", "2"]
EXCLUDED_STORE = "10110"
COST_CENTRE_LEDGER = "505"
TRANSFER = "026"

CONSUMED = ["move_type_id", "store_id", "cost_centre_id", "item_id"]


def consumption(tables: Tables, window: Column, location: str, *also: Column) -> DataFrame:
    """Net quantity and value per (location, move type, store, cost centre, item) and what else is asked for.

    The ledger is summed on its own codes before it meets stores, items, move
    types and cost centres, so the joins carry one row per combination.
    """
    net = or_zero("qty_cr") - or_zero("qty_dr")
    moves = tables.mms_item_ledger.where(
        window
        & F.col("move_type_id").isin(CONSUMPTION_MOVES)
        & (F.col("store_id") != EXCLUDED_STORE)
    )
    summed = moves.groupBy(*CONSUMED, *also).agg(
        F.sum(net).alias("qty"), F.sum(net * F.col("unit_cost")).alias("value")
    )
    sub_stores = tables.store.where(F.col("main_sub") == "S").select("store_id")
    centres = tables.gl_sub_ledgers.where(
        (F.col("ledger_type_code") == COST_CENTRE_LEDGER) & (F.col("location_id") == location)
    ).select("location_id", "sub_ldgr_item_code", "sub_ldgr_item_desc")
    stores = tables.store.select("store_id", F.col("description").alias("store"))
    items = tables.item.select("item_id", F.col("description").alias("item"))
    return (
        not_in(summed, "store_id", sub_stores)
        .join(stores, "store_id")
        .join(items, "item_id")
        .join(tables.def_move_type.select("move_type_id"), "move_type_id")
        .join(centres, F.col("cost_centre_id") == F.col("sub_ldgr_item_code"))
    )


def transfers(tables: Tables, start: Moment, end: Moment, from_store: str) -> DataFrame:
    """Transfer lines out of stores whose upper-case description matches the pattern."""
    sources = tables.store.where(
        F.upper(F.col("description")).like(like_pattern(from_store.upper()))
    ).select(F.col("store_id").alias("from_store_id"), F.col("description").alias("from_store"))
    targets = tables.store.select(
        F.col("store_id").alias("to_store_id"), F.col("description").alias("to_store")
    )
    carriers = tables.vu_information.select(F.col("mrno").alias("delivered_by"))
    dated = tables.store_transfer_master.where(from_until(F.col("approved_date"), start, end))
    approved = (
        dated.join(sources, "from_store_id")
        .join(targets, "to_store_id")
        .join(carriers, "delivered_by")
    )
    lines = near(tables, tables.store_transfer_detail, "trans_no", dated).where(
        F.col("transaction_type_id") == TRANSFER
    )
    cost = F.col("moving_average_cost")
    return lines.join(approved, "trans_no").select(
        "trans_no",
        "approved_date",
        "from_store",
        "to_store",
        "item_id",
        "transfered_qty",
        (cost * F.col("transfered_qty")).cast("decimal(38,6)").alias("value"),
        "cancel_qty",
        (cost * F.col("cancel_qty")).cast("decimal(38,6)").alias("cancel"),
    )
