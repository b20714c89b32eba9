"""Signed billing lines: what was invoiced, less what was returned.

Everything known per document is worked out at document level first, for
invoices and returns in one frame.  The lines, by far the largest tables, then
meet one narrow side of it each, on their own number: invoice lines on
``invoice_no``, return lines on ``return_no``.  So runtime filters, pruning and
bucketing by these numbers reach them, and each table of lines is scanned once:

``is_return, doc_no``  the document a line belongs to
``copies``             how many times SQL's joins would repeat that document

Repeats are counted instead of produced, because an amount that appears n times
adds n times itself to a sum and nothing to a distinct count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardbook.functions.distincts import counted, numbered_partials
from wardbook.functions.joins import join_reduced
from wardbook.functions.moments import Moment, from_until, last_days
from wardbook.functions.predicates import matches_if_given
from wardbook.operators.ranges import in_months_of, near
from wardbook.sources.catalog import Tables
from wardbook.sources.clustered import MONTH

# The description of the emergency location, which reports take
# as a parameter, and the stream names of the revenue dashboard.
EMERGENCY = "ADULT/PAEDS-EMERGENCY - FMH"
INPATIENT_STREAM = "ipd_revenue"
EMERGENCY_STREAM = "ear_revenue"
OUTPATIENT_STREAM = "opd_revenue"

DOCUMENT = ["is_return", "doc_no"]
STAY = ["mrno", "admission_no"]
ORDER = ["order_type_id", "order_no", "location_id", "order_location_id"]
PLACE = ["location_id", "order_location_id"]


@dataclass(frozen=True)
class Encounters:
    """Documents of a report: ``met`` after all joins, ``candidates`` a superset that few joins give.

    Candidates only bound what is scanned of the lines, by number or by month.
    ``dated`` says that a condition on the headers themselves picks the
    candidates; then Spark can make a filter of their numbers for the lines.
    """

    candidates: DataFrame
    met: DataFrame
    dated: bool = False

    def union(self, other: Encounters) -> Encounters:
        return Encounters(
            self.candidates.unionByName(other.candidates), self.met.unionByName(other.met)
        )


@dataclass(frozen=True)
class Filters:
    """Optional text filters of the revenue reports; unset ones still drop NULLs."""

    name: str | None = None
    department: str | None = None
    sub_ledger: str | None = None
    patient_type: str | None = None


def documents(tables: Tables) -> DataFrame:
    """Invoice and return headers in one frame, keyed by (is_return, doc_no)."""
    shared = [*STAY, *ORDER]
    invoices = tables.invoice_master.select(
        F.lit(False).alias("is_return"),
        F.col("invoice_no").alias("doc_no"),
        F.col("invoice_date").alias("doc_date"),
        "invoice_no",
        *shared,
    )
    returns = tables.return_master.select(
        F.lit(True).alias("is_return"),
        F.col("return_no").alias("doc_no"),
        F.col("return_date").alias("doc_date"),
        "invoice_no",
        *shared,
    )
    return invoices.unionByName(returns)


def bill_lines(tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Invoice lines, and return lines with the amount negated."""
    shared = ["serial_no", "contract_id", "item_id", "client_id", "income_id", "department_id"]
    billed = tables.invoice_master_bill_dist.select(
        F.col("invoice_no").alias("doc_no"),
        *shared,
        "qty",
        "amount",
        *by_month(tables.invoice_master_bill_dist),
    )
    returned = tables.return_master_bill_dist.select(
        F.col("return_no").alias("doc_no"),
        *shared,
        (-F.col("qty")).cast("decimal(18,2)").alias("qty"),
        (-F.col("amount")).cast("decimal(18,2)").alias("amount"),
        *by_month(tables.return_master_bill_dist),
    )
    return billed, returned


def by_month(lines: DataFrame) -> list[str]:
    """The month column of lines that are stored by month."""
    return [MONTH] if MONTH in lines.columns else []


def lines_of(
    tables: Tables, encounters: Encounters, met: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Invoice lines and return lines with the columns of the document they belong to.

    The two stay apart: each is partitioned by its own number after the join,
    and what compares or sums lines of a document needs no other shuffle.
    """

    def side(lines: DataFrame, is_return: bool) -> DataFrame:
        of_side = F.col("is_return") == F.lit(is_return)
        candidates = encounters.candidates.where(of_side)
        rows = in_months_of(near(tables, lines, "doc_no", candidates), candidates, "doc_date")
        if encounters.dated:
            # Says nothing new, but lets a runtime filter see the dates behind the joins of ``met``.
            rows = rows.join(candidates.select("doc_no"), "doc_no", "left_semi")
        ours = met.where(of_side).drop("is_return")
        return rows.join(ours, "doc_no").withColumn("is_return", F.lit(is_return))

    billed, returned = bill_lines(tables)
    return side(billed, False), side(returned, True)


def doctors(tables: Tables) -> DataFrame:
    return tables.v_doctor.select(
        F.col("doctor_id").alias("__doctor"),
        F.col("name").alias("doctor"),
        "department",
    )


def typed_orders(tables: Tables, patient_type: Column, placed: DataFrame) -> DataFrame:
    """Orders with the description of their patient type, to be joined to ``placed`` on their number."""
    types = tables.patient_type.select(
        F.col("patient_type_id"), F.col("description").alias("patient_type")
    ).where(patient_type)
    return near(tables, tables.order_master, "order_no", placed).join(types, "patient_type_id")


def patients(tables: Tables) -> DataFrame:
    return tables.v_patient.select("mrno", F.col("name").alias("pat_name"))


def stays(tables: Tables, admissions: DataFrame, filters: Filters | None) -> DataFrame:
    """Admissions with their order's patient type, admitting doctor and patient.

    ``filters`` is None where the report has no text filters at all; then a
    missing doctor name or patient type does not drop the stay.
    """
    asked = filters or Filters()
    anything = F.lit(True)
    by_type = matches_if_given(F.col("patient_type"), asked.patient_type) if filters else anything
    by_doctor = (
        matches_if_given(F.col("doctor"), asked.name)
        & matches_if_given(F.col("department"), asked.department)
        if filters
        else anything
    )
    admitting = doctors(tables).where(by_doctor)
    return (
        admissions.join(typed_orders(tables, by_type, admissions), ORDER)
        .join(admitting, F.col("doctor_id") == F.col("__doctor"))
        .join(patients(tables), "mrno")
        .drop(*ORDER, "doctor_id", "__doctor", "patient_type_id", "reffering_inhouse_doctor_id")
    )


def located(tables: Tables, admitted: DataFrame, location: Column) -> DataFrame:
    """Documents with the description of their order location."""
    places = tables.order_location.select(
        *PLACE, F.col("description").alias("order_location")
    ).where(location)
    return admitted.join(places, PLACE).drop(*ORDER)


def admitted_encounters(
    tables: Tables,
    start: Moment,
    end: Moment,
    filters: Filters,
    emergency: bool,
    emergency_place: str = EMERGENCY,
) -> Encounters:
    """Documents of stays that got a final invoice in the window, by care setting."""
    there = F.upper(F.col("order_location")) == emergency_place.upper()
    finals = tables.final_invoice_master.where(
        from_until(F.col("final_invoice_date"), start, end)
    ).select("admission_no")
    admitted = near(tables, tables.order_patient_admission, "admission_no", finals)
    admissions = join_reduced(admitted, finals.distinct(), ["admission_no"], "left_semi").select(
        *STAY,
        *ORDER,
        "doctor_id",
        "admission_final_time",
        "discharge_date",
        "order_admission_type",
    )
    headers = near(tables, documents(tables), "admission_no", finals)
    candidates = join_reduced(headers, finals.distinct(), ["admission_no"], "left_semi")
    at = located(tables, headers, there if emergency else ~there)
    return Encounters(candidates, at.join(stays(tables, admissions, filters), STAY))


def outpatient_encounters(
    tables: Tables, start: Moment, end: Moment, filters: Filters
) -> Encounters:
    """Documents without an admission, dated in the window, by referring doctor."""
    by_type = matches_if_given(F.col("patient_type"), filters.patient_type)
    referring = doctors(tables).where(
        matches_if_given(F.col("doctor"), filters.name)
        & matches_if_given(F.col("department"), filters.department)
    )
    candidates = documents(tables).where(
        F.col("admission_no").isNull() & from_until(F.col("doc_date"), start, end)
    )
    met = (
        candidates.join(typed_orders(tables, by_type, candidates), ORDER)
        .join(referring, F.col("reffering_inhouse_doctor_id") == F.col("__doctor"))
        .join(patients(tables), "mrno")
        .select(
            *DOCUMENT,
            "doc_date",
            "invoice_no",
            *STAY,
            "pat_name",
            "doctor",
            "department",
            "patient_type",
        )
    )
    return Encounters(candidates, met, dated=True)


REVENUE_GROUP = ["doctor", "department", "sub_ldgr_desc", "patient_type", "cl_name", "in_setup"]
ENCOUNTER_GROUP = [*DOCUMENT, *STAY, "invoice_no", "doctor", "department", "patient_type"]


def with_names(
    tables: Tables, lines: DataFrame, sub_ledger: str | None, each_name_once: bool
) -> DataFrame:
    """Add income head, client and sub-ledger names; a NULL in any of the keys drops the line.

    The sub-ledger is found by item code alone, so a code listed under two
    ledger types repeats the line.  ``each_name_once`` lists every (key, name)
    pair once, which is all a set union can tell apart.  Names are added after
    the lines met their document, so the big shuffle carries codes only.
    """
    heads = tables.income_setup.select("income_id", F.col("income_description").alias("in_setup"))
    clients = tables.client.select("client_id", F.col("name").alias("cl_name"))
    ledgers = tables.gl_sub_ledgers.select(
        F.col("sub_ldgr_item_code").alias("department_id"),
        F.col("sub_ldgr_item_desc").alias("sub_ldgr_desc"),
    ).where(matches_if_given(F.col("sub_ldgr_desc"), sub_ledger))
    if each_name_once:
        heads, clients, ledgers = heads.distinct(), clients.distinct(), ledgers.distinct()
    return lines.join(heads, "income_id").join(clients, "client_id").join(ledgers, "department_id")


def revenue_as_bag(tables: Tables, encounters: Encounters, filters: Filters) -> DataFrame:
    """Every line as often as the joins give it (UNION ALL), summed per document and codes before the names."""
    met = encounters.met.select(*DOCUMENT, "invoice_no", "doctor", "department", "patient_type")
    codes = ["income_id", "client_id", "department_id"]

    def per_document(lines: DataFrame) -> DataFrame:
        return lines.groupBy(
            "doc_no", "invoice_no", "doctor", "department", "patient_type", *codes
        ).agg(F.sum("amount").alias("amount"))

    billed, returned = lines_of(tables, encounters, met)
    lines = per_document(billed).unionByName(per_document(returned))
    named = with_names(tables, lines, filters.sub_ledger, each_name_once=False)
    return revenue_totals(tables, named, F.col("amount"))


def revenue_as_set(
    tables: Tables, encounters: Encounters, filters: Filters, line_identity: list[str]
) -> DataFrame:
    """Every distinct line once (UNION).

    ``line_identity`` lists the line's own columns of the union.  The two
    branches never share a row (only returns have a return number), so the
    duplicates all lie within one document.  Lines with equal codes are found
    where the document's lines already are; the few that different codes with
    equal names still leave are found after the names.  Document columns the totals do not use only tell documents
    apart; the distinct combinations of them are counted per document and
    stay out of the line-level comparison.
    """
    told_apart = (
        encounters.met.distinct().groupBy(*ENCOUNTER_GROUP).agg(F.count(F.lit(1)).alias("copies"))
    )
    codes = ["income_id", "client_id", "department_id"]
    kept = [*ENCOUNTER_GROUP, "copies", *line_identity, "amount"]

    def once(lines: DataFrame) -> DataFrame:
        coded = lines.select(*dict.fromkeys([*kept, *codes])).distinct()
        named = with_names(tables, coded, filters.sub_ledger, each_name_once=True)
        return named.select(*kept, "cl_name", "sub_ldgr_desc", "in_setup").distinct()

    billed, returned = lines_of(tables, encounters, told_apart)
    lines = once(billed).unionByName(once(returned))
    return revenue_totals(tables, lines, F.col("amount") * F.col("copies").cast("decimal(9,0)"))


def revenue_totals(tables: Tables, lines: DataFrame, amount: Column) -> DataFrame:
    """Invoices and amounts by name.

    Where a catalog says ``count_by_bits``, invoices are counted as sets of bits and the lines are
    not dealt out by their numbers again; each group then holds 4 KB for every 32,768 numbers it has one of.
    """
    if tables.count_by_bits:
        partials = numbered_partials(lines, REVENUE_GROUP, "invoice_no", total=amount)
        totals = counted(partials, REVENUE_GROUP, "invoice_count", ["total"])
        return totals.withColumn("total", F.col("total").cast("decimal(28,2)"))
    return lines.groupBy(*REVENUE_GROUP).agg(
        F.count_distinct("invoice_no").alias("invoice_count"),
        F.sum(amount).cast("decimal(28,2)").alias("total"),
    )


def recent_stays(
    tables: Tables, as_of: Moment | None, emergency_place: str = EMERGENCY
) -> Encounters:
    """Dashboard side of inpatient and emergency: (document, stream, copies).

    Inpatient lines repeat for every recent final invoice of the stay,
    emergency lines count once however many there are.
    """
    finals = tables.final_invoice_master.where(
        last_days(F.col("final_invoice_date"), as_of)
    ).select("admission_no")
    counted = finals.groupBy("admission_no").agg(F.count(F.lit(1)).alias("finals"))
    admitted = near(tables, tables.order_patient_admission, "admission_no", finals)
    admissions = join_reduced(
        admitted.select(*STAY, *ORDER, "doctor_id"), counted, ["admission_no"]
    )
    headers = near(tables, documents(tables), "admission_no", finals)
    candidates = join_reduced(headers, counted.select("admission_no"), ["admission_no"], "left_semi")
    emergency = F.col("order_location") == emergency_place
    met = (
        located(tables, headers, F.col("order_location").isNotNull())
        .join(stays(tables, admissions, None), STAY)
        .select(
            *DOCUMENT,
            F.when(emergency, EMERGENCY_STREAM).otherwise(INPATIENT_STREAM).alias("stream"),
            F.when(emergency, F.lit(1)).otherwise(F.col("finals")).alias("copies"),
        )
    )
    return Encounters(candidates, met)


def recent_outpatients(tables: Tables, as_of: Moment | None) -> Encounters:
    """Dashboard side of outpatient; a document without a referring doctor stays in."""
    candidates = documents(tables).where(
        F.col("admission_no").isNull() & last_days(F.col("doc_date"), as_of)
    )
    met = (
        candidates.join(typed_orders(tables, F.lit(True), candidates), ORDER)
        .join(
            doctors(tables),
            F.col("reffering_inhouse_doctor_id") == F.col("__doctor"),
            "left",
        )
        .join(patients(tables), "mrno")
        .select(
            *DOCUMENT,
            F.lit(OUTPATIENT_STREAM).alias("stream"),
            F.lit(1).cast("bigint").alias("copies"),
        )
    )
    return Encounters(candidates, met)


def revenue_by_head(tables: Tables, recent: Encounters) -> DataFrame:
    """(stream, in_setup, amount) of the recent documents.

    Lines are summed per key before the names are joined on, so the joins that
    keep unknown clients and departments see a few thousand rows, not the lines.
    """
    billed, returned = lines_of(tables, recent, recent.met)
    summed = (
        billed.unionByName(returned)
        .groupBy("stream", "income_id", "client_id", "department_id")
        .agg(F.sum(F.col("amount") * F.col("copies").cast("decimal(9,0)")).alias("amount"))
    )
    heads = tables.income_setup.select("income_id", F.col("income_description").alias("in_setup"))
    clients = tables.client.select("client_id")
    ledgers = tables.gl_sub_ledgers.select(F.col("sub_ldgr_item_code").alias("department_id"))
    return (
        summed.join(heads, "income_id")
        .join(clients, "client_id", "left")
        .join(ledgers, "department_id", "left")
        .groupBy("stream", "in_setup")
        .agg(F.sum("amount").cast("decimal(28,2)").alias("amount"))
    )
