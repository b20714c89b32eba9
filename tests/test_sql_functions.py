"""Reports called in SQL: equal to the reports, and open to the caller's filters."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry_module
from helpers import rows_of, settings
from wardbook.plans import sql_functions
from wardbook.plans.registry import REPORTS
from wardbook.sources.catalog import Tables
from wardbook.sources.fixtures import fixture_tables
from wardbook.sources.schemas import SCHEMAS

CALLS = {
    "inpatient_revenue": "inpatient_revenue(date'1997-01-01', date'1998-01-01')",
    "general_ledger": "general_ledger(date'1997-01-01', date'1998-01-01', '2', '200000000', '299999999')",
    "client_receipts": "client_receipts(date'1997-01-01', date'1997-02-01')",
}


@pytest.fixture(scope="module")
def tables(spark, small_dir):
    return fixture_tables(spark, small_dir)


@pytest.mark.parametrize("key", list(CALLS))
def test_a_call_is_the_report(spark, tables, key):
    assert set(sql_functions.define(tables)) == set(CALLS)
    report = REPORTS[key](tables, **entry_module.PARAMETERS[key])
    called = spark.sql(f"select * from {CALLS[key]}")
    assert called.dtypes == report.dtypes
    assert rows_of(called) and rows_of(called) == rows_of(report)


def test_text_filters_are_parameters(spark, tables):
    sql_functions.define(tables)
    wanted = REPORTS["inpatient_revenue"](tables, start="1997-01-01", end="1998-01-01", department="1", patient_type="h")
    called = spark.sql(
        "select * from inpatient_revenue(date'1997-01-01', date'1998-01-01', department_has => '1', patient_type_has => 'h')"
    )
    assert rows_of(called) == rows_of(wanted)


def test_the_callers_filter_reaches_the_scans(spark, tmp_path):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    sql_functions.define(Tables.from_files(spark, str(tmp_path)))
    with settings(spark, spark__sql__maxMetadataStringLength="5000"):
        for sql, table, pushed in (
            ("inpatient_revenue(date'2024-01-01', date'2024-02-01') where adm_department = 'SURGERY'", "v_doctor",
             r"EqualTo\(department,SURGERY\)"),
            ("inpatient_revenue(date'2024-01-01', date'2024-02-01') where cl_name = 'Payer'", "client", r"EqualTo\(name,Payer\)"),
            ("client_receipts(date'2024-01-01', date'2024-02-01') where receive_no = 7", "cash_receive_detail",
             r"EqualTo\(receive_no,7\)"),
            ("general_ledger(date'2024-01-01', date'2024-02-01', '2', '20', '29') where voucher_no = 7", "gl_tran_detail",
             r"EqualTo\(voucher_no,7\)"),
        ):
            plan = spark.sql(f"select * from {sql}")._jdf.queryExecution().executedPlan().toString()
            scans = [line for line in plan.splitlines() if "FileScan" in line and f"/{table}]" in line]
            assert scans and all(re.search(pushed, scan) for scan in scans), (sql, scans)
