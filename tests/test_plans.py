"""What the physical plans must and must not hold."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from helpers import rows_of, settings
from wardbook.operators.billing import EMERGENCY
from wardbook.plans import ledger, revenue
from wardbook.plans.registry import REPORTS
from wardbook.sources.catalog import Tables
from wardbook.sources.fixtures import fixture_tables
from wardbook.sources.schemas import SCHEMAS


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
    ):
        yield


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Empty tables as parquet files, so a plan shows what reaches the scan."""
    folder = tmp_path_factory.mktemp("tables")
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).coalesce(1).write.parquet(f"{folder}/{name}")
    return Tables.from_files(spark, str(folder))


@pytest.fixture
def long_plans(spark):
    with settings(spark, spark__sql__maxMetadataStringLength="5000"):
        yield


@pytest.mark.parametrize("key", list(REPORTS))
def test_no_cross_join_no_python_and_no_forced_broadcast(key, tables, no_broadcast):
    plan = plan_of(REPORTS[key](tables, **entry_module.PARAMETERS.get(key, {})))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BroadcastHashJoin", plan)
    assert not re.search(r"EvalPython|InPandas|InArrow", plan)


def scan_of(plan: str, column: str) -> str:
    (scan,) = {line for line in plan.splitlines() if "FileScan" in line and f"{column}#" in line}
    return scan


def test_filters_and_columns_reach_the_scan(tables, long_plans):
    plan = plan_of(ledger.general_ledger(tables, "2024-01-01", "2024-02-01", "2", "20", "29"))
    headers = scan_of(plan, "voucher_status")
    assert "GreaterThanOrEqual(trans_date,2024-01-01T00:00)" in headers
    assert "LessThan(trans_date,2024-02-01T00:00)" in headers
    assert "In(voucher_status, [P,T])" in headers
    lines = scan_of(plan, "dr_amount")
    assert "StringStartsWith(coa_code,2)" in lines and "LessThanOrEqual(coa_code,29)" in lines
    assert "trans_date" not in lines


def test_fiscal_year_bounds_reach_the_scan(tables, long_plans):
    plan = plan_of(ledger.corporate_billing_monthly(tables, "2023-24"))
    scan = scan_of(plan, "dr_amount")
    assert "EqualTo(coa_code,1113116004)" in scan
    assert re.search(r"DataFilters: \[.*trans_date.*>= .*[Ss]ubquery", scan)


def test_set_revenue_compares_lines_without_another_shuffle(tables, no_broadcast):
    """Lines are shuffled once, to their document, and first compared right there, before any name."""
    plan = plan_of(revenue.emergency_revenue(tables, "2024-01-01", "2024-02-01")).splitlines()
    joins = [n for n, line in enumerate(plan) if re.search(r"SortMergeJoin \[doc_no#\d+L\], \[doc_no#\d+L\], Inner", line)]
    assert len(joins) == 2
    for join in joins:
        above = list(reversed(plan[:join]))
        compared = next(n for n, line in enumerate(above) if "HashAggregate(keys=[" in line)
        assert "doc_no" in above[compared] and "income_id" in above[compared]
        assert not any("Exchange" in line for line in above[:compared])
        assert "HashAggregate" in above[compared + 1] and "Exchange" not in above[compared + 1]


def test_runtime_filter_thins_both_tables_of_lines(tables, no_broadcast, spark, long_plans):
    with settings(
        spark, spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0"
    ):
        plan = plan_of(revenue.outpatient_revenue(tables, "2024-01-01", "2024-02-01"))
    for number in ("invoice_no", "return_no"):
        assert re.search(rf"might_contain\([^\n]*xxhash64\({number}#", plan)


@pytest.mark.parametrize(
    "report", ["inpatient_revenue", "emergency_revenue", "outpatient_revenue", "revenue_dashboard"]
)
def test_bucketed_lines_are_not_shuffled(spark, tables, no_broadcast, report):
    numbers = {"invoice_master_bill_dist": "invoice_no", "return_master_bill_dist": "return_no"}
    for name, number in numbers.items():
        spark.sql(f"drop table if exists bucketed_{name}")
        empty = spark.createDataFrame([], SCHEMAS[name])
        empty.write.bucketBy(2, number).sortBy(number).saveAsTable(f"bucketed_{name}")
    bucketed = Tables(lambda name: spark.table(f"bucketed_{name}") if name in numbers else tables[name])
    dates = ("2024-01-31",) if report == "revenue_dashboard" else ("2024-01-01", "2024-02-01")
    plan = plan_of(REPORTS[report](bucketed, *dates)).splitlines()
    for name in numbers:
        (scan,) = (n for n, line in enumerate(plan) if "FileScan" in line and f"bucketed_{name}" in line)
        below_join = next(n for n in range(scan, -1, -1) if "SortMergeJoin [doc_no" in plan[n])
        assert not any("Exchange" in line for line in plan[below_join + 1 : scan])
    for name in numbers:
        spark.sql(f"drop table bucketed_{name}")


@pytest.mark.parametrize(
    ("key", "join_key"),
    [
        ("client_receipts", "receive_no"),
        ("client_unadjusted_receipts", "receive_no"),
        ("card_receipts", "receive_no"),
        ("pharmacy_transfers", "trans_no"),
        ("general_ledger", "voucher_no"),
    ],
)
def test_lines_meet_their_header_straight_out_of_a_shuffle(key, join_key, tables, no_broadcast):
    """Only then can adaptive execution split one receipt, transfer or voucher with very many lines."""
    plan = plan_of(REPORTS[key](tables, **entry_module.PARAMETERS.get(key, {}))).splitlines()
    for number, line in enumerate(plan):
        if re.search(rf"SortMergeJoin \[[^]]*\b{join_key}#\d+L\], \[", line):
            depth = line.index("SortMergeJoin")
            below = [text for text in plan[number + 1 :] if len(text) > depth]
            left = below[0:2]
            assert "Sort [" in left[0] and "Exchange hashpartitioning" in left[1]
            break
    else:
        pytest.fail("no join on the header's number")


def test_dashboard_reads_the_lines_once(tables, long_plans):
    plan = plan_of(revenue.revenue_dashboard(tables, "2024-01-31"))
    for name in ("invoice_master_bill_dist", "return_master_bill_dist"):
        assert len(re.findall(rf"FileScan[^\n]*/{name}\]", plan)) == 1


def test_number_ranges_reach_the_line_scans_when_asked(tables, long_plans):
    try:
        tables.numbers_follow_time = True
        plan = plan_of(revenue.outpatient_revenue(tables, "2024-01-01", "2024-02-01"))
    finally:
        tables.numbers_follow_time = False
    for lines, number in (
        ("invoice_master_bill_dist", "invoice_no"),
        ("return_master_bill_dist", "return_no"),
    ):
        (scan,) = (line for line in plan.splitlines() if f"/{lines}]" in line)
        assert re.search(rf"DataFilters: \[[^]]*{number}#\d+L >= [^]]*[Ss]ubquery", scan)


BOUNDED = {
    "inpatient_revenue": [("order_master", "order_no")],
    "emergency_revenue": [("invoice_master_bill_dist", "invoice_no")],
    "outpatient_revenue": [("order_master", "order_no")],
    "panel_inpatient": [("order_master", "order_no")],
    "panel_emergency": [("return_master_bill_dist", "return_no")],
    "panel_outpatient": [("order_master", "order_no")],
    "revenue_dashboard": [("invoice_master_bill_dist", "invoice_no")],
    "client_receipts": [("cash_receive_detail", "receive_no")],
    "kpi_client_receipts": [("cash_receive_detail", "receive_no")],
    "card_receipts": [("cash_receive_detail", "receive_no")],
    "pharmacy_transfers": [("store_transfer_detail", "trans_no")],
    "kpi_pharmacy_consumption": [("store_transfer_detail", "trans_no")],
    "general_ledger": [("gl_tran_detail", "voucher_no")],
    "fund_general_ledger": [("pf_tran_detail", "voucher_no")],
}


@pytest.mark.parametrize("key", list(BOUNDED))
def test_numbers_are_bounded_when_asked(tables, long_plans, key):
    try:
        tables.numbers_follow_time = True
        plan = plan_of(REPORTS[key](tables, **entry_module.PARAMETERS.get(key, {})))
    finally:
        tables.numbers_follow_time = False
    for table, number in BOUNDED[key]:
        scans = [line for line in plan.splitlines() if "FileScan" in line and f"/{table}]" in line]
        assert scans
        for scan in scans:
            assert re.search(rf"DataFilters: \[.*{number}#\d+L >= .*[Ss]ubquery", scan)


@pytest.mark.parametrize("key", list(BOUNDED))
def test_number_ranges_change_no_result(spark, small_dir, key):
    built = fixture_tables(spark, small_dir)
    plain = rows_of(REPORTS[key](built, **entry_module.PARAMETERS.get(key, {})))
    built.numbers_follow_time = True
    assert rows_of(REPORTS[key](built, **entry_module.PARAMETERS.get(key, {}))) == plain


def hot_hospital(spark, lines: int) -> Tables:
    """Thousands of invoices of which one has a third of all lines, and one patient a third of stays."""
    documents = 3000
    number = F.col("id") % documents
    stays = spark.range(1, documents, 1, 8)
    header = stays.selectExpr(
        "id as invoice_no",
        "timestamp_ntz '2024-01-10' as invoice_date",
        "if(id % 3 = 0, 7L, id) as mrno",
        "id as admission_no",
        "101 as location_id",
        "1L as order_location_id",
        "1L as order_type_id",
        "id as order_no",
    )
    billed = spark.range(0, lines, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.greatest(number, F.lit(1))).alias("invoice_no"),
        F.col("id").cast("int").alias("serial_no"),
        *(F.lit(value).alias(name) for name, value in {"contract_id": 1, "item_id": 1}.items()),
        F.lit(1).alias("qty"),
        F.lit(2).alias("amount"),
        F.lit("c1").alias("client_id"),
        F.lit(4).alias("income_id"),
        F.lit(11).alias("department_id"),
    )
    frames = {
        "invoice_master": header,
        "invoice_master_bill_dist": billed,
        "order_patient_admission": header.selectExpr(
            "mrno",
            "admission_no",
            "3L as doctor_id",
            "location_id",
            "order_location_id",
            "order_type_id",
            "order_no",
            "cast(null as timestamp_ntz) as admission_final_time",
            "cast(null as timestamp_ntz) as discharge_date",
            "'F' as order_admission_type",
        ),
        "order_master": header.selectExpr(
            "order_type_id",
            "order_no",
            "location_id",
            "order_location_id",
            "2 as patient_type_id",
            "3L as reffering_inhouse_doctor_id",
        ),
        "patient_type": spark.sql("select 2 as patient_type_id, 'Panel' as description"),
        "v_doctor": spark.sql("select 3 as doctor_id, 'Dr' as name, 'Dep' as department"),
        "v_patient": stays.selectExpr("id as mrno", "concat('P', id) as name", "'' as nic_new"),
        "client": spark.sql("select 'c1' as client_id, 'Payer' as name"),
        "income_setup": spark.sql("select 4 as income_id, 'Theatre' as income_description"),
        "gl_sub_ledgers": spark.sql(
            "select 11 as sub_ldgr_item_code, 'T' as sub_ldgr_item_desc, '505' as ledger_type_code,"
            " '101' as location_id"
        ),
        "order_location": spark.sql(
            f"select 101 as location_id, 1 as order_location_id, '{EMERGENCY}' as description"
        ),
        "final_invoice_master": header.selectExpr(
            "invoice_no as final_invoice_no",
            "invoice_no as client_invoice_no",
            "'c1' as client_id",
            "mrno",
            "1L as process_id",
            "invoice_date as final_invoice_date",
            "'I' as final_invoice_type",
            "1 as net_receivable",
            "0 as received_amount",
            "admission_no",
            "invoice_date as admission_date",
        ),
    }
    for name in ("return_master", "return_master_bill_dist"):
        frames[name] = spark.createDataFrame([], SCHEMAS[name])
    return Tables.from_frames(frames)


def test_one_invoice_with_a_third_of_the_lines_is_split(spark, no_broadcast):
    lines = 60_000
    report = revenue.emergency_revenue(hot_hospital(spark, lines), "2024-01-01", "2024-02-01")
    with settings(
        spark,
        spark__sql__shuffle__partitions="8",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="40KB",
    ):
        found = [(row.invoice_count, row.receivable) for row in report.collect()]
        plan = plan_of(report)
    assert found == [(2000, 2 * lines)]
    assert "skew=true" in plan and "skewed" in plan


def test_details_without_a_letter_are_dealt_out_by_invoice(spark, no_broadcast):
    """Half of the details have no letter: they meet nothing, and do not gather under one key."""
    invoices = 400
    finals = spark.range(1, invoices + 1).selectExpr(
        "id as final_invoice_no",
        "if(id % 2 = 0, id - 1, id) as client_invoice_no",
        "'c1' as client_id",
        "id as mrno",
        "7L as process_id",
        "timestamp_ntz '2024-01-10' as final_invoice_date",
        "if(id % 2 = 0, 'I', 'R') as final_invoice_type",
        "10 as net_receivable",
        "1 as received_amount",
        "if(id % 4 = 0, id, null) as admission_no",
        "timestamp_ntz '2024-01-08' as admission_date",
    )
    details = spark.range(1, invoices * 20 + 1).selectExpr(
        "7L as process_id",
        "'c1' as client_id",
        f"if((id % {invoices}) % 2 = 0, id % {invoices} - 1, id % {invoices}) as final_invoice_no",
        f"id % {invoices} as mrno",
        "if(id % 2 = 0 and id % 3 = 0, 5L, null) as ref_letter_no",
        f"if((id % {invoices}) % 4 = 0, id % {invoices}, null) as admission_no",
    )
    frames = {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
    frames |= {
        "final_invoice_master": finals,
        "pbs_tran_detail_corporate": details,
        "ref_letter_master": spark.range(5, 9).selectExpr(
            "id as ref_letter_no",
            "concat('L', id) as client_ref_no",
            "id as mrno",
            "timestamp_ntz '2024-01-01' as trans_date",
        ),
        "client": spark.sql("select 'c1' as client_id, 'Payer' as name"),
        "v_patient": finals.selectExpr("mrno", "concat('P', mrno) as name", "'' as nic_new"),
    }
    report = REPORTS["debtor_aging_open"](Tables.from_frames(frames), cutoff="2023-01-01")
    rows = report.where(F.col("final_invoice_type") == "I").collect()
    assert len(rows) == invoices // 2
    with_details = [row for row in rows if row["mrno"] != invoices]
    assert all(row["ref_letter_no"] == "L5" for row in with_details)
    assert all((row["admission_no"] is not None) == (row["mrno"] % 4 == 0) for row in with_details)
    plan = plan_of(report)
    assert re.search(r"Exchange hashpartitioning\(letter#", plan)
    assert not re.search(r"Exchange hashpartitioning\(ref_letter_no#", plan)


def below(plan: list[str], at: int, word: str) -> list[str]:
    """The lines of the subtree whose top is ``word`` in line ``at``: those that begin deeper."""
    depth = plan[at].index(word)
    rest = plan[at + 1 :]
    end = next((n for n, line in enumerate(rest) if re.search(r"[A-Za-z]", line).start() <= depth), len(rest))
    return rest[:end]


@pytest.mark.parametrize("key", ["debtor_aging_open", "debtor_aging_settled"])
def test_lookups_are_aggregated_for_asked_keys_only(key, tables):
    """Letters and admissions meet the keys of the chosen details below their grouping, not after it."""
    report = REPORTS[key](tables, **entry_module.PARAMETERS.get(key, {}))
    plan = report._jdf.queryExecution().optimizedPlan().toString().splitlines()
    for aggregate, source in (("max(admission_date#", "admission_date#"), ("min(client_ref_no#", "client_ref_no#")):
        at = [n for n, line in enumerate(plan) if "Aggregate [" in line and aggregate in line]
        inner = max(at)
        subtree = below(plan, inner, "Aggregate")
        relation = next(n for n, line in enumerate(subtree) if "Relation [" in line and source in line)
        assert any("Join LeftSemi" in line for line in subtree[:relation]), subtree


def scans_run(frame) -> list[str]:
    """The scans that an executed adaptive plan really ran: those of final plans, without what was read again."""
    found, final = [], False
    for line in frame._jdf.queryExecution().executedPlan().toString().splitlines():
        if "== Final Plan ==" in line or "== Initial Plan ==" in line:
            final = "Final" in line
        elif final and "FileScan" in line:
            found.append(line)
    return found


def test_front_page_scans_invoices_once(spark, world, tmp_path):
    """Both figures of invoices, one of them a join of the table with itself, come from one scan."""
    rows = [
        {"final_invoice_no": n, "client_invoice_no": 1 + n % 7, "client_id": "c1", "mrno": 7, "process_id": 1,
         "final_invoice_date": "2024-03-05", "final_invoice_type": "RHIO"[n % 4], "net_receivable": 10 * n, "received_amount": n}
        for n in range(1, 60)
    ]
    made = world(final_invoice_master=rows, client=[{"client_id": "c1", "name": "P"}], v_patient=[{"mrno": 7, "name": "Q"}])
    stored = ("final_invoice_master", "client", "v_patient")
    for name in stored:
        made[name].write.parquet(f"{tmp_path}/{name}")
    ward = Tables(lambda name: spark.read.parquet(f"{tmp_path}/{name}") if name in stored else made[name])
    page = REPORTS["kpi_dashboard"](ward, as_of="2024-03-31", cutoff="2024-01-01", transfer_start="2024-01-01", transfer_end="2024-02-01")
    row = page.first()
    page.collect()
    assert row.total_receivable == REPORTS["kpi_total_receivable"](ward, cutoff="2024-01-01").first()[0] > 0
    assert row.total_debtor_billing == REPORTS["kpi_debtor_billing"](ward, as_of="2024-03-31").first()[0] > 0
    assert len({line.strip(" :+-") for line in scans_run(page) if "net_receivable" in line}) == 1


@pytest.mark.parametrize("key", ["debtor_aging_open", "debtor_aging_settled"])
def test_chosen_details_are_shuffled_once(spark, small_dir, key):
    """Three branches read the distinct details; they are made once."""
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1"):
        report = REPORTS[key](fixture_tables(spark, small_dir), **entry_module.PARAMETERS.get(key, {}))
        report.collect()
        plan = report._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("== Initial Plan ==")]
    assert final.count("ReusedExchange") >= 2
