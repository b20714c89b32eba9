"""Writing a report to files, in parallel and in the report's order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns each sheet shows as dates, their format, and the
# sheets that show every value as text and NULL as an empty cell.
SHEET_DATE = "dd-MMM-yyyy"
SHEET_DATE_COLUMNS: dict[str, tuple[str, ...]] = {
    "client_receipt_adjustment": ("receive_date",),
    "referral_letter_amounts": ("ref_letter_trans_date",),
    "debtor_aging_open": ("final_invoice_date", "admission_date"),
    "debtor_aging_settled": ("final_invoice_date", "admission_date"),
    "general_ledger": ("trans_date",),
    "allowance_deductions": ("joining_date",),
    "loan_deductions": ("end_date",),
    "client_receipts": ("receive_date",),
    "client_unadjusted_receipts": ("receive_date",),
    "card_receipts": ("receive_date", "validity_date"),
    "donations_by_location": ("receipt_date", "printed_on"),
    "donations_report": ("receipt_date", "printed_on"),
    "stock_movement_daily": ("transaction_date",),
    "fund_general_ledger": ("trans_date",),
    "pharmacy_transfers": ("approved_date",),
}
TEXT_SHEETS = frozenset({"allowance_deductions", "loan_deductions"})


def sheet(report: str, frame: DataFrame) -> DataFrame:
    """The report as its sheet shows it."""
    dates = SHEET_DATE_COLUMNS.get(report, ())
    cells = []
    for name in frame.columns:
        cell = F.date_format(name, SHEET_DATE) if name in dates else F.col(name)
        if report in TEXT_SHEETS:
            cell = F.coalesce(cell.cast("string"), F.lit(""))
        cells.append(cell.alias(name))
    return frame.select(*cells)


def write_sheet(report: str, frame: DataFrame, path: str, mode: str = "error") -> None:
    """Write the report's sheet as CSV part files, each with a header."""
    (
        sheet(report, frame)
        .write.mode(mode)
        .option("header", True)
        .option("emptyValue", "")
        .csv(path)
    )


def write_rows(frame: DataFrame, path: str, mode: str = "error") -> None:
    """Write one JSON object per row; NULL fields are kept."""
    frame.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_table(frame: DataFrame, path: str, mode: str = "error") -> None:
    """Write the report with its types, for other Spark jobs."""
    frame.write.mode(mode).parquet(path)
