"""Donations with donor, purpose and payment mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.sources.catalog import Tables

PURPOSE = ["donation_type_id", "donation_group_id"]


def described_donations(tables: Tables, donations: DataFrame) -> DataFrame:
    """Donations of known donors, types and modes; an unknown account falls back to the type."""
    donors = tables.donor.select("donor_id", "mobile")
    types = tables.donation_types.select(*PURPOSE, F.col("description").alias("type_description"))
    modes = tables.payment_mode.select(
        F.col("payment_mode_id").alias("mode_id"), F.col("description").alias("mode_of_payment")
    )
    accounts = tables.gl_coa.select(F.col("coa_code").alias("coa_code_cr"), "coa_description")
    return (
        donations.join(types, PURPOSE)
        .join(modes, "mode_id")
        .join(accounts, "coa_code_cr", "left")
        .join(donors, "donor_id")
        .withColumns(
            {
                "party_name": F.coalesce("name_for_other", "donor_name"),
                "address": F.coalesce("address_for_other", "donor_address"),
                "on_account_of": F.coalesce("coa_description", "type_description"),
            }
        )
    )
