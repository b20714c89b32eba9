"""Revenue by care setting: three detailed reports and the dashboard panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.functions.columns import in_order
from wardbook.functions.moments import Moment
from wardbook.operators import billing
from wardbook.operators.billing import Encounters, Filters
from wardbook.sources.catalog import Tables

ADMITTED_LINE = ["serial_no", "contract_id", "item_id", "qty", "client_id", "department_id"]
OUTPATIENT_LINE = ["serial_no", "item_id", "qty"]


def _as_admitted(totals: DataFrame) -> DataFrame:
    report = totals.select(
        F.col("doctor").alias("adm_doctor"),
        F.col("department").alias("adm_department"),
        "sub_ldgr_desc",
        "patient_type",
        "cl_name",
        "in_setup",
        "invoice_count",
        F.col("total").alias("receivable"),
    )
    return in_order(report, "adm_department", "in_setup")


def inpatient_revenue(
    tables: Tables,
    start: Moment,
    end: Moment,
    name: str | None = None,
    department: str | None = None,
    sub_ledger: str | None = None,
    patient_type: str | None = None,
    emergency_place: str = billing.EMERGENCY,
) -> DataFrame:
    """Invoices and amount of stays finalised in [start, end), emergency left out."""
    filters = Filters(name, department, sub_ledger, patient_type)
    met = billing.admitted_encounters(tables, start, end, filters, False, emergency_place)
    return _as_admitted(billing.revenue_as_bag(tables, met, filters))


def emergency_revenue(
    tables: Tables,
    start: Moment,
    end: Moment,
    name: str | None = None,
    department: str | None = None,
    sub_ledger: str | None = None,
    patient_type: str | None = None,
    emergency_place: str = billing.EMERGENCY,
) -> DataFrame:
    """The same for the emergency location, where equal lines count once."""
    filters = Filters(name, department, sub_ledger, patient_type)
    met = billing.admitted_encounters(tables, start, end, filters, True, emergency_place)
    return _as_admitted(billing.revenue_as_set(tables, met, filters, ADMITTED_LINE))


def outpatient_revenue(
    tables: Tables,
    start: Moment,
    end: Moment,
    name: str | None = None,
    department: str | None = None,
    sub_ledger: str | None = None,
    patient_type: str | None = None,
) -> DataFrame:
    """Invoices and amount without an admission, dated in [start, end); equal lines count once."""
    filters = Filters(name, department, sub_ledger, patient_type)
    met = billing.outpatient_encounters(tables, start, end, filters)
    totals = billing.revenue_as_set(tables, met, filters, OUTPATIENT_LINE)
    return in_order(totals.withColumnRenamed("total", "total_amt"), "department")


def _panel(tables: Tables, recent: Encounters, stream: str) -> DataFrame:
    met = recent.met.where(F.col("stream") == stream)
    heads = billing.revenue_by_head(tables, Encounters(recent.candidates, met))
    return in_order(heads.select("in_setup", "amount"), "in_setup")


def panel_inpatient(
    tables: Tables, as_of: Moment | None = None, emergency_place: str = billing.EMERGENCY
) -> DataFrame:
    """Inpatient revenue by income head, final invoices of the last 30 days."""
    recent = billing.recent_stays(tables, as_of, emergency_place)
    return _panel(tables, recent, billing.INPATIENT_STREAM)


def panel_emergency(
    tables: Tables, as_of: Moment | None = None, emergency_place: str = billing.EMERGENCY
) -> DataFrame:
    """Emergency revenue by income head, final invoices of the last 30 days."""
    recent = billing.recent_stays(tables, as_of, emergency_place)
    return _panel(tables, recent, billing.EMERGENCY_STREAM)


def panel_outpatient(tables: Tables, as_of: Moment | None = None) -> DataFrame:
    """Outpatient revenue by income head, documents of the last 30 days."""
    recent = billing.recent_outpatients(tables, as_of)
    return _panel(tables, recent, billing.OUTPATIENT_STREAM).withColumnRenamed(
        "amount", "total_amt"
    )


def revenue_dashboard(
    tables: Tables, as_of: Moment | None = None, emergency_place: str = billing.EMERGENCY
) -> DataFrame:
    """The three panels in one frame and one pass over the lines."""
    recent = billing.recent_stays(tables, as_of, emergency_place).union(
        billing.recent_outpatients(tables, as_of)
    )
    return in_order(billing.revenue_by_head(tables, recent), "stream", "in_setup")
