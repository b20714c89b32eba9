"""Reports as table functions of a session, to be called, filtered and joined in SQL.

``define(tables)`` makes a temporary view of each report's rows before its
parameters, and a temporary SQL function that takes them. A call is not a table that was
computed beforehand: Spark puts the function's body into the query, so what the
caller asks beyond the parameters reaches the scans as well.

    select sum(receivable) from inpatient_revenue(date'2024-01-01', date'2024-02-01') where adm_department = 'SURGERY'
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardbook.functions.moments import from_until
from wardbook.operators import billing
from wardbook.operators.billing import Encounters, Filters
from wardbook.operators.receipts import client_receipt_lines
from wardbook.operators.vouchers import voucher_lines
from wardbook.sources.catalog import Tables

# Bounds that every date of the source lies between.
EVER = ("1000-01-01", "9999-12-31")

WINDOW = "start_at TIMESTAMP_NTZ, end_before TIMESTAMP_NTZ"
CONTAINS = "lower({column}) LIKE replace('%' || lower(coalesce({given}, '')) || '%', '\\\\', '\\\\\\\\')"
RECEIPTS = [
    "receive_date", "received_by", "received_by_name", "receive_no", "payment_mode", "instrument_no", "net_amount",
    "wht_tax", "gross_amount", "client_id", "client", "final_invoice_no", "remarks",
]


def stay_lines(tables: Tables, emergency_place: str = billing.EMERGENCY) -> DataFrame:
    """Signed, named lines of all stays outside the emergency location, with the number of the stay."""
    nothing_asked = Filters()
    there = F.upper(F.col("order_location")) == emergency_place.upper()
    headers = billing.documents(tables).where(F.col("admission_no").isNotNull())
    admissions = tables.order_patient_admission.where(F.col("admission_no").isNotNull()).select(
        *billing.STAY, *billing.ORDER, "doctor_id"
    )
    met = billing.located(tables, headers, ~there).join(
        billing.stays(tables, admissions, nothing_asked), billing.STAY
    )
    kept = met.select(*billing.DOCUMENT, "invoice_no", "admission_no", "doctor", "department", "patient_type")
    billed, returned = billing.lines_of(tables, Encounters(headers, kept), kept)
    named = billing.with_names(tables, billed.unionByName(returned), None, each_name_once=False)
    return named.select("admission_no", "invoice_no", *billing.REVENUE_GROUP, "amount")


def contains(column: str, given: str) -> str:
    """A case-blind "contains" that drops NULLs, also where nothing is given."""
    return CONTAINS.format(column=column, given=given)


def define(tables: Tables, emergency_place: str = billing.EMERGENCY) -> list[str]:
    """Make the functions in the session of ``tables`` and return their names; a second call replaces them."""
    spark = tables.final_invoice_master.sparkSession
    finals = tables.final_invoice_master.select("admission_no", "final_invoice_date")
    vouchers = voucher_lines(tables, tables.gl_tran_master, tables.gl_tran_detail, *EVER, "left")
    receipts = tables.cash_receive_master.where(from_until(F.col("receive_date"), *EVER))
    views = {
        "ward_stay_lines": stay_lines(tables, emergency_place),
        "ward_finals": finals,
        "ward_voucher_lines": vouchers,
        "ward_client_receipts": client_receipt_lines(tables, receipts).select(*RECEIPTS),
    }
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)
    names = ", ".join(billing.REVENUE_GROUP)
    bodies = {
        "inpatient_revenue": (
            f"{WINDOW}, name_has STRING DEFAULT NULL, department_has STRING DEFAULT NULL,"
            " sub_ledger_has STRING DEFAULT NULL, patient_type_has STRING DEFAULT NULL",
            f"""SELECT doctor AS adm_doctor, department AS adm_department, sub_ldgr_desc, patient_type, cl_name, in_setup,
                       count(DISTINCT invoice_no) AS invoice_count, CAST(sum(amount) AS DECIMAL(28,2)) AS receivable
                FROM ward_stay_lines AS l LEFT SEMI JOIN ward_finals AS f
                  ON f.admission_no = l.admission_no AND f.final_invoice_date >= start_at AND f.final_invoice_date < end_before
                WHERE {contains("doctor", "name_has")} AND {contains("department", "department_has")}
                  AND {contains("sub_ldgr_desc", "sub_ledger_has")} AND {contains("patient_type", "patient_type_has")}
                GROUP BY {names}""",
        ),
        "general_ledger": (
            f"{WINDOW}, coa_prefix STRING, coa_from STRING, coa_to STRING",
            """SELECT * FROM ward_voucher_lines
               WHERE trans_date >= start_at AND trans_date < end_before
                 AND coa_code LIKE replace(coa_prefix, '\\\\', '\\\\\\\\') || '%' AND coa_code BETWEEN coa_from AND coa_to""",
        ),
        "client_receipts": (
            WINDOW,
            "SELECT * FROM ward_client_receipts WHERE receive_date >= start_at AND receive_date < end_before",
        ),
    }
    for name, (parameters, body) in bodies.items():
        columns = _columns(spark, body, parameters)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
    return list(bodies)


def _columns(spark: SparkSession, body: str, parameters: str) -> str:
    """Names and types of what a body returns, from its plan with a typed NULL in place of each parameter."""
    for parameter in parameters.split(", "):
        name, kind = parameter.split()[:2]
        body = re.sub(rf"\b{name}\b", f"CAST(NULL AS {kind})", body)
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.sql(body).schema)
