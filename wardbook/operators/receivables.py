"""Client invoices that are open or settled, and what is known about their stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardbook.functions.columns import or_zero
from wardbook.functions.joins import aggregates_for, join_reduced
from wardbook.functions.moments import Moment, literal, parse_moment
from wardbook.sources.catalog import Tables

# Final invoice types.
OPEN_TYPES = ["I", "O", "H"]
CLIENT_INVOICE_TYPES = ["R", "H"]

INVOICE = ["process_id", "client_id", "client_invoice_no", "mrno"]


def addressed_invoices(tables: Tables, invoices: DataFrame) -> DataFrame:
    """Final invoices with the names of their client and patient; both must exist."""
    clients = tables.client.select("client_id", F.col("name").alias("client_name"))
    patients = tables.v_patient.select("mrno", F.col("name").alias("patient_name"), "nic_new")
    remaining = or_zero("net_receivable") - or_zero("received_amount")
    return (
        invoices.withColumn("remaining", remaining.cast("decimal(28,2)"))
        .join(clients, "client_id")
        .join(patients, "mrno")
    )


def unpaid_client_invoices(tables: Tables, cutoff: Moment) -> DataFrame:
    """Numbers of the client invoices after the cutoff that are under-received."""
    unpaid = tables.final_invoice_master.where(
        (or_zero("net_receivable") > or_zero("received_amount"))
        & F.col("final_invoice_type").isin(CLIENT_INVOICE_TYPES)
        & (F.col("final_invoice_date") > literal(parse_moment(cutoff, "cutoff")))
    )
    return unpaid.select(F.col("final_invoice_no").alias("client_invoice_no")).distinct()


def open_invoices(tables: Tables, client_invoices: DataFrame) -> DataFrame:
    """Under-received invoices billed through one of the client invoices."""
    finals = tables.final_invoice_master
    outstanding = F.coalesce(F.abs("net_receivable"), F.lit(0)) - or_zero("received_amount") > 0
    invoices = finals.where(outstanding & F.col("final_invoice_type").isin(OPEN_TYPES)).drop(
        "admission_no", "admission_date"
    )
    return join_reduced(invoices, client_invoices, ["client_invoice_no"], "left_semi")


def invoice_figures(tables: Tables, cutoff: Moment, billed: Column) -> DataFrame:
    """One row: what remains on all open client invoices, and the sum of ``billed`` client invoices, from one scan.

    Each invoice is listed once for every part it plays: as an unpaid client
    invoice under its own number, as an open one under the number it is billed
    through, as a billed one under none. Sums by number, client and patient are
    the only thing shuffled, and all that follows reads that one shuffle again
    instead of the table. For that no branch may ask the listing for less than
    the others: keys are never NULL, so that no join adds a filter to them, and each branch's filter holds all sums.
    """
    remaining = or_zero("net_receivable") - or_zero("received_amount")
    client_invoice = F.col("final_invoice_type").isin(CLIENT_INVOICE_TYPES)
    unpaid = (
        (or_zero("net_receivable") > or_zero("received_amount"))
        & client_invoice
        & (F.col("final_invoice_date") > literal(parse_moment(cutoff, "cutoff")))
        & F.col("final_invoice_no").isNotNull()
    )
    outstanding = F.coalesce(F.abs("net_receivable"), F.lit(0)) - or_zero("received_amount") > 0
    known = F.col("client_id").isNotNull() & F.col("mrno").isNotNull() & F.col("client_invoice_no").isNotNull()
    none = F.lit(None)

    def part(plays: Column, number=none, client=none, patient=none, unpaid=0, remains=none, billed=none) -> Column:
        return F.struct(
            F.coalesce(plays, F.lit(False)).alias("plays"),
            number.cast("bigint").alias("number"),
            client.cast("string").alias("client"),
            patient.cast("bigint").alias("patient"),
            F.lit(unpaid).alias("unpaid"),
            remains.cast("decimal(28,2)").alias("remains"),
            billed.cast("decimal(28,2)").alias("billed"),
        )

    parts = F.array(
        part(unpaid, F.col("final_invoice_no"), unpaid=1),
        part(
            outstanding & known & F.col("final_invoice_type").isin(OPEN_TYPES),
            F.col("client_invoice_no"),
            F.col("client_id"),
            F.col("mrno"),
            remains=remaining,
        ),
        part(client_invoice & billed, billed=F.col("net_receivable")),
    )
    listed = (
        tables.final_invoice_master.select(F.inline(parts))
        .where("plays")
        .groupBy(
            F.coalesce("number", F.lit(0)).alias("number"),
            F.coalesce("client", F.lit("")).alias("client_id"),
            F.coalesce("patient", F.lit(0)).alias("mrno"),
        )
        .agg(F.sum("unpaid").alias("unpaid"), F.sum("remains").alias("remains"), F.sum("billed").alias("billed"))
        .withColumns({name: F.col(name).cast("decimal(28,2)") for name in ("remains", "billed")})
    )
    # True of any sums there can be, which only the optimizer does not know.
    ever = F.col("unpaid") + or_zero("remains") + or_zero("billed") > F.lit("-1e30").cast("decimal(31,0)")
    numbers = listed.where(ever & (F.col("unpaid") > 0)).select("number").distinct()
    still_open = join_reduced(
        listed.where(ever & F.col("remains").isNotNull()), numbers, ["number"], "left_semi"
    )
    remaining_on = (
        still_open.join(tables.client.select("client_id"), "client_id")
        .join(tables.v_patient.select("mrno"), "mrno")
        .select("remains", none.cast("decimal(28,2)").alias("billed"))
    )
    billed_on = listed.where(ever).select(none.cast("decimal(28,2)").alias("remains"), "billed")

    def total(column: str, name: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).cast("decimal(28,2)").alias(name)

    return remaining_on.unionByName(billed_on).agg(total("remains", "total_receivable"), total("billed", "billing"))


def settled_invoices(tables: Tables) -> DataFrame:
    """Invoices that round to nothing left, of processes that have corporate details.

    The (process, client) pairs are reduced to distinct ones first: there are
    few of them, and a client with very many invoices is then not shuffled.
    """
    process = ["process_id", "client_id"]
    pairs = tables.pbs_tran_detail_corporate.select(*process).distinct()
    left = or_zero("net_receivable") - or_zero("received_amount")
    invoices = tables.final_invoice_master.where(F.abs(F.round(left)) == 0).drop(
        "admission_no", "admission_date"
    )
    return join_reduced(invoices, pairs, process, "left_semi")


def with_stay_details(tables: Tables, invoices: DataFrame) -> DataFrame:
    """Name the invoices and add first reference letter, last admission and last admission date of each.

    The three values come from one aggregation of those corporate details that
    belong to the invoices; repeated details are dropped first, as minima and
    maxima are the same without them. Letters and admissions are aggregated for the keys
    of these details alone (``aggregates_for``). The distinct details feed all three
    branches, so Spark shuffles them once and reads that shuffle again. Details without a letter are
    dealt out by their invoice, so they do not gather in one task.
    """
    details = (
        join_reduced(
            tables.pbs_tran_detail_corporate.withColumnRenamed("final_invoice_no", "client_invoice_no"),
            invoices.select(*INVOICE).distinct(),
            INVOICE,
            "left_semi",
        )
        .select(*INVOICE, "admission_no", F.col("ref_letter_no").cast("string").alias("letter"))
        .distinct()
    )
    letters = aggregates_for(
        details,
        tables.ref_letter_master.select(F.col("ref_letter_no").cast("string").alias("letter"), "client_ref_no"),
        ["letter"],
        F.min("client_ref_no").alias("client_ref_no"),
    )
    admitted = aggregates_for(
        details,
        tables.final_invoice_master.select("admission_no", "mrno", "admission_date"),
        ["admission_no", "mrno"],
        F.max("admission_date").alias("admission_date"),
    )
    without = F.concat(F.lit("without letter "), F.col("client_invoice_no").cast("string"))
    details = details.withColumn("letter", F.coalesce("letter", without))
    per_invoice = (
        details.join(letters, "letter", "left")
        .join(admitted, ["admission_no", "mrno"], "left")
        .groupBy(*INVOICE)
        .agg(
            F.min("client_ref_no").alias("ref_letter_no"),
            F.max("admission_no").alias("admission_no"),
            F.max("admission_date").alias("admission_date"),
        )
    )
    return join_reduced(addressed_invoices(tables, invoices), per_invoice, INVOICE, "left")
