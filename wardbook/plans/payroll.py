"""Payroll allowances, deductions and loans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.functions.columns import in_order
from wardbook.functions.moments import Moment, from_through
from wardbook.sources.catalog import Tables

# The allowance code left out, the location of loan types and
# the month label of the payroll reports.
EXCLUDED_ALLOWANCE = "000"
DEFAULT_LOCATION = "101"
MONTH = "MMM-yy"


def allowance_deductions(tables: Tables, start: Moment, end: Moment) -> DataFrame:
    """Arrears together with allowances and deductions from ``start`` through ``end``, no row twice.

    Repeats are removed from the payments and from the employees before the
    two meet on the employee's number, which leaves none in the result.
    """
    payment = ["location_id", "mrno", "code", "description", "month", "amount"]
    month = F.date_format("end_date", MONTH).alias("month")
    kept = F.col("location_id").isNotNull() & from_through(F.col("end_date"), start, end)
    arrears = (
        tables.pay_arrear.where(kept & (F.col("amount") > 0))
        .select("location_id", "mrno", F.col("arrear_code").alias("code"), month, "amount")
        .join(tables.def_arrear.withColumnRenamed("arrear_code", "code"), "code")
    )
    allowances = (
        tables.pay_allowance_deduction.where(kept & (F.col("calc_amount") > 0))
        .select(
            "location_id",
            "mrno",
            F.col("ad_code").alias("code"),
            month,
            F.col("calc_amount").alias("amount"),
        )
        .join(
            tables.def_allowance_deduction.withColumnRenamed("ad_code", "code").where(
                F.col("code") != EXCLUDED_ALLOWANCE
            ),
            "code",
        )
    )
    payments = arrears.select(*payment).union(allowances.select(*payment)).distinct()
    employees = tables.vu_information.distinct()
    rows = payments.join(employees, "mrno").select(
        "location_id",
        "mrno",
        "name",
        "department",
        "designation",
        "code",
        "description",
        "month",
        "amount",
        "joining_date",
        "nic",
    )
    return in_order(rows, "description", "month", "mrno")


def loan_deductions(
    tables: Tables, start: Moment, end: Moment, location: str = DEFAULT_LOCATION
) -> DataFrame:
    """Loan refunds from ``start`` through ``end`` with loan type, employee and loan location."""
    types = tables.def_loan_type.where(F.col("location_id") == location).select(
        "loan_code", F.col("description").alias("loan_type")
    )
    places = tables.location.select(
        F.col("location_id").alias("loan_location_id"), "description"
    )
    employees = tables.v_information.select("mrno", "name", "designation", "department")
    loans = (
        tables.loan_payment_master.join(types, "loan_code")
        .join(places, "loan_location_id")
        .join(employees, "mrno")
        .drop("mrno")
    )
    rows = (
        tables.loan_refund_detail.where(from_through(F.col("end_date"), start, end))
        .join(loans, "loan_no")
        .select(
            "description",
            "end_date",
            F.date_format("end_date", MONTH).alias("month"),
            "loan_type",
            "mrno",
            "name",
            "designation",
            "department",
            "loan_amount",
            "refund_amount",
        )
    )
    return in_order(rows, "description", "mrno", "loan_type")
