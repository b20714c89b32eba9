"""The clustered layout of documents and lines: equal results, no moved lines, unopened months."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from helpers import rows_of, settings
from wardbook.plans.registry import REPORTS
from wardbook.sources.catalog import Tables
from wardbook.sources.clustered import DOCUMENTS, MONTH, clustered_tables, line_months, write_clustered
from wardbook.sources.fixtures import fixture_tables

LINES = [lines for _, lines, _, _ in DOCUMENTS]
REVENUE = ["inpatient_revenue", "emergency_revenue", "outpatient_revenue", "panel_emergency", "revenue_dashboard"]


@pytest.fixture(scope="module")
def plain(spark, small_dir):
    return fixture_tables(spark, small_dir)


@pytest.fixture(scope="module")
def clustered(spark, plain, tmp_path_factory):
    spark.sql("create database if not exists clustered_ward")
    write_clustered(plain, "clustered_ward", 4, str(tmp_path_factory.mktemp("clustered")))
    yield clustered_tables(spark, "clustered_ward", plain)
    spark.sql("drop database clustered_ward cascade")


@pytest.mark.parametrize("key", REVENUE)
def test_reports_are_the_same(plain, clustered, key):
    arguments = entry_module.PARAMETERS[key]
    found = rows_of(REPORTS[key](clustered, **arguments))
    assert found and found == rows_of(REPORTS[key](plain, **arguments))


@pytest.fixture
def fixed_plans(spark):
    with settings(
        spark,
        spark__sql__adaptive__enabled="false",
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__maxMetadataStringLength="5000",
    ):
        yield


def executed(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan()


@pytest.mark.parametrize("key", ["inpatient_revenue", "outpatient_revenue"])
def test_lines_are_not_moved_to_their_documents(clustered, fixed_plans, key):
    plan = executed(REPORTS[key](clustered, "1997-01-01", "1997-02-01")).toString().splitlines()
    for name in LINES:
        scan = next(n for n, line in enumerate(plan) if "FileScan" in line and f"clustered_ward.{name}" in line)
        assert re.search(rf"PartitionFilters: \[.*dynamicpruning.*{MONTH}#", plan[scan])
        join = next(n for n in range(scan, -1, -1) if "SortMergeJoin [doc_no" in plan[n])
        assert not any("Exchange" in line for line in plan[join + 1 : scan])


def files_read(plan, name):
    leaves = plan.collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    (scan,) = {s.toString(): s for s in scans if f"clustered_ward.{name}" in s.toString()}.values()
    return scan.metrics().apply("numFiles").value()


@pytest.mark.parametrize("key", ["inpatient_revenue", "outpatient_revenue"])
def test_a_month_leaves_other_months_closed(spark, clustered, fixed_plans, key):
    plan = executed(REPORTS[key](clustered, "1997-01-01", "1997-02-01"))
    for name in LINES:
        of_all = len(spark.table(f"clustered_ward.{name}").inputFiles())
        assert 0 < files_read(plan, name) < of_all / 8


def test_a_bucket_of_a_month_is_one_file(spark, clustered):
    files = spark.table(f"clustered_ward.{LINES[0]}").select(F.input_file_name().alias("file"), MONTH, "invoice_no")
    of_bucket = files.groupBy(MONTH, F.pmod(F.hash("invoice_no"), F.lit(4)).alias("bucket")).agg(
        F.count_distinct("file").alias("files")
    )
    assert {row["files"] for row in of_bucket.collect()} == {1}


def test_months_of_odd_numbers(spark):
    rows = [
        (1, "2024-01-05", 1), (1, "2024-01-30", 2),
        (2, "2024-01-05", 3), (2, "2024-02-01", 4),
        (3, None, 5), (4, None, 6), (4, "2024-03-01", 7), (None, "2024-01-01", 8),
    ]
    headers = spark.createDataFrame(rows, "number bigint, text string, id int").select(
        "number", F.col("text").cast("timestamp_ntz").alias("dated")
    )
    found = {row[0]: str(row[1]) for row in line_months(headers, "number", "dated").collect()}
    assert found == {1: "2024-01-01", 2: "1000-01-01", 3: "1000-01-01", 4: "1000-01-01"}


def test_lines_of_odd_documents_are_not_missed(spark, world, tmp_path):
    """A number whose headers are of two months, and lines without a header."""
    header = {"admission_no": None, "mrno": 1, "location_id": 101, "order_location_id": 1, "order_type_id": 1, "order_no": 1}
    line = {"serial_no": 1, "contract_id": 1, "item_id": 1, "qty": 1, "client_id": "c", "income_id": 4, "department_id": 11}
    tables = world(
        invoice_master=[
            {**header, "invoice_no": 1, "invoice_date": "2024-01-05"},
            {**header, "invoice_no": 1, "invoice_date": "2024-03-05"},
            {**header, "invoice_no": 2, "invoice_date": "2024-02-05"},
        ],
        invoice_master_bill_dist=[{**line, "invoice_no": n, "amount": n} for n in (1, 2, 3)],
        order_master=[{"order_type_id": 1, "order_no": 1, "location_id": 101, "order_location_id": 1, "patient_type_id": 2,
                       "reffering_inhouse_doctor_id": 3}],
        patient_type=[{"patient_type_id": 2, "description": "Panel"}],
        v_doctor=[{"doctor_id": 3, "name": "Dr", "department": "Dep"}],
        v_patient=[{"mrno": 1, "name": "Pat"}],
        client=[{"client_id": "c", "name": "Payer"}],
        income_setup=[{"income_id": 4, "income_description": "Theatre"}],
        gl_sub_ledgers=[{"sub_ldgr_item_code": 11, "sub_ldgr_item_desc": "T", "ledger_type_code": "505"}],
    )
    spark.sql("create database if not exists odd_ward")
    write_clustered(tables, "odd_ward", 2, str(tmp_path))
    stored = clustered_tables(spark, "odd_ward", tables)
    for start, end in (("2024-01-01", "2024-02-01"), ("2024-02-01", "2024-03-01"), ("2024-03-01", "2024-04-01")):
        found = rows_of(REPORTS["outpatient_revenue"](stored, start, end))
        assert found and found == rows_of(REPORTS["outpatient_revenue"](tables, start, end))
    assert rows_of(REPORTS["outpatient_revenue"](stored, "2025-01-01", "2025-02-01")) == []
    spark.sql("drop database odd_ward cascade")


def test_other_catalogs_have_no_months(world):
    assert isinstance(world(), Tables) and MONTH not in world().invoice_master_bill_dist.columns
