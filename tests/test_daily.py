"""Rolling figures from day partitions: equal to the direct reports, also after late rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import settings
from wardbook.operators import daily
from wardbook.plans import donations, receivables, stock
from wardbook.sources.catalog import Tables
from wardbook.sources.fixtures import fixture_tables

AS_OF = "2001-07-31"


def direct(tables, as_of, days=30):
    """The four figures by their own reports."""
    used = stock.kpi_consumption(tables, as_of).first()
    return {
        "client_receipts": (None, receivables.kpi_client_receipts(tables, as_of).first()[0]),
        "consumption": (used.consumption_qty, used.consumption_value),
        "debtor_billing": (None, receivables.kpi_debtor_billing(tables, as_of).first()[0]),
        "donations": (None, donations.kpi_donations(tables, as_of).first()[0]),
    }


def found(frame):
    return {row["figure"]: (row["quantity"], row["amount"]) for row in frame.collect()}


def test_figures_of_the_test_tables(spark, small_dir, tmp_path):
    tables, folder = fixture_tables(spark, small_dir), str(tmp_path / "days")
    daily.refresh_days(tables, folder, start="2001-06-01")
    wanted = direct(tables, AS_OF)
    assert all(amount for _, amount in wanted.values())
    assert found(daily.rolling_figures(tables, folder, AS_OF)) == wanted


def invoices(spark, rows):
    return spark.createDataFrame(
        rows, "final_invoice_no bigint, dated string, net_receivable int, kind string"
    ).select(
        "final_invoice_no",
        F.lit(1).cast("bigint").alias("client_invoice_no"),
        F.lit("c").alias("client_id"),
        F.lit(1).cast("bigint").alias("mrno"),
        F.lit(1).cast("bigint").alias("process_id"),
        F.col("dated").cast("timestamp_ntz").alias("final_invoice_date"),
        F.col("kind").alias("final_invoice_type"),
        "net_receivable",
        F.lit(0).alias("received_amount"),
        F.lit(None).cast("bigint").alias("admission_no"),
        F.lit(None).cast("timestamp_ntz").alias("admission_date"),
    )


@pytest.fixture
def ward(spark, world):
    """Tables that are empty but for the invoices given."""
    empty = world()

    def build(rows):
        frame = invoices(spark, rows)
        return Tables(lambda name: frame if name == "final_invoice_master" else empty[name])

    return build


FIRST = [
    (1, "2024-03-01 00:00:00", 1, "R"),
    (2, "2024-03-01 08:00:00", 2, "H"),
    (3, "2024-03-01 09:00:00", 4, "I"),
    (4, "2024-03-02 23:59:00", 8, "R"),
    (5, "2024-03-31 10:00:00", 16, "R"),
    (6, "2024-05-01 00:00:00", 32, "R"),
    (7, "2024-02-29 23:59:59", 64, "R"),
]


def billing(tables, folder, as_of):
    return found(daily.rolling_figures(tables, folder, as_of))["debtor_billing"][1]


@pytest.mark.parametrize("as_of", ["2024-03-31", "2024-04-01", "2024-06-15"])
def test_whole_days(ward, tmp_path, as_of):
    tables = ward(FIRST)
    daily.refresh_days(tables, str(tmp_path / "d"))
    assert billing(tables, str(tmp_path / "d"), as_of) == receivables.kpi_debtor_billing(tables, as_of).first()[0]


def test_a_window_that_begins_within_a_day(ward, tmp_path):
    from datetime import datetime

    tables, folder = ward(FIRST), str(tmp_path / "d")
    daily.refresh_days(tables, folder)
    for as_of in (datetime(2024, 3, 31, 8), datetime(2024, 3, 31, 8, 0, 1), datetime(2024, 3, 31, 23, 59)):
        assert billing(tables, folder, as_of) == receivables.kpi_debtor_billing(tables, as_of).first()[0]


def test_late_moved_and_vanished_rows(ward, tmp_path):
    folder = str(tmp_path / "d")
    daily.refresh_days(ward(FIRST), folder)
    late = ward([*FIRST[:4], *FIRST[5:], (8, "2024-03-02 01:00:00", 128, "H")])
    assert billing(late, folder, "2024-03-31") == 1 + 2 + 8 + 16 + 32, "nothing is written yet"
    daily.refresh_days(late, folder, "2024-03-02", "2024-03-03")
    assert billing(late, folder, "2024-03-31") == 1 + 2 + 8 + 16 + 32 + 128, "the vanished row's day is untouched"
    daily.refresh_days(late, folder, "2024-03-31", "2024-04-01")
    wanted = receivables.kpi_debtor_billing(late, "2024-03-31").first()[0]
    assert billing(late, folder, "2024-03-31") == wanted == 1 + 2 + 8 + 32 + 128
    daily.refresh_days(late, folder)
    daily.refresh_days(late, folder)
    assert billing(late, folder, "2024-03-31") == wanted, "writing twice changes nothing"


def test_only_days_of_the_window_are_opened(spark, ward, tmp_path):
    tables, folder = ward(FIRST), str(tmp_path / "d")
    daily.refresh_days(tables, folder)
    with settings(spark, spark__sql__adaptive__enabled="false", spark__sql__maxMetadataStringLength="4000"):
        frame = daily.rolling_figures(tables, folder, "2024-04-30")
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan()
        leaves = [plan.collectLeaves().apply(i) for i in range(plan.collectLeaves().size())]
        (scan,) = [leaf for leaf in leaves if "day#" in leaf.toString() and "FileScan" in leaf.toString()]
        assert scan.metrics().apply("numPartitions").value() == 1 + 1, "31 March and 1 May of six days"


def test_nothing_stored_and_nothing_there(ward, tmp_path):
    tables = ward([])
    assert billing(tables, str(tmp_path / "none"), AS_OF) == 0
    daily.refresh_days(tables, str(tmp_path / "none"))
    assert found(daily.rolling_figures(tables, str(tmp_path / "none"), AS_OF)) == direct(tables, AS_OF)
    with pytest.raises(ValueError, match="midnights"):
        from datetime import datetime

        daily.refresh_days(tables, str(tmp_path / "none"), datetime(2024, 1, 1, 5))
