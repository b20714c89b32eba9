"""Reports that must agree with each other, on the whole test tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wardbook.plans import dashboard, ledger, receivables, revenue, stock
from wardbook.sources.catalog import Tables
from wardbook.sources.fixtures import fixture_tables

AS_OF = "2001-07-31"


@pytest.fixture(scope="module")
def tables(spark, small_dir):
    return fixture_tables(spark, small_dir)


def only(frame):
    return frame.first()[0]


def test_total_receivable_is_what_remains_on_open_invoices(tables):
    rows = receivables.debtor_aging_open(tables, "1996-01-01")
    assert only(receivables.kpi_total_receivable(tables, "1996-01-01")) == only(
        rows.agg(F.sum("remaining"))
    )


def test_client_receipts_figure_is_the_report_of_the_same_window(tables):
    rows = receivables.client_receipts(tables, "2001-07-01", "2100-01-01")
    assert only(receivables.kpi_client_receipts(tables, AS_OF)) == only(
        rows.agg(F.sum("gross_amount"))
    )


def test_consumption_figures_are_the_report_of_the_same_window(tables):
    rows = stock.consumption_analysis(tables, "2001-07-01", "2100-01-01", "101")
    figure = stock.kpi_consumption(tables, AS_OF).first()
    assert tuple(figure) == tuple(rows.agg(F.sum("qty"), F.sum("value")).first())


def test_front_page_repeats_its_figures(tables):
    page = dashboard.kpi_dashboard(tables, AS_OF, "1996-01-01", "1997-01-01", "1997-02-01").first()
    assert page.client_receipts == only(receivables.kpi_client_receipts(tables, AS_OF))
    assert page.total_debtor_billing == only(receivables.kpi_debtor_billing(tables, AS_OF))
    assert (page.consumption_quantity, page.consumption_value) == tuple(
        stock.kpi_consumption(tables, AS_OF).first()
    )


def test_panels_add_up_to_the_revenue_dashboard(tables):
    streams = revenue.revenue_dashboard(tables, AS_OF).groupBy("stream").agg(F.sum("amount"))
    whole = {row[0]: row[1] for row in streams.collect()}
    assert whole == {
        "ipd_revenue": only(revenue.panel_inpatient(tables, AS_OF).agg(F.sum("amount"))),
        "ear_revenue": only(revenue.panel_emergency(tables, AS_OF).agg(F.sum("amount"))),
        "opd_revenue": only(revenue.panel_outpatient(tables, AS_OF).agg(F.sum("total_amt"))),
    }


def test_twelve_months_make_the_year(tables):
    """Vouchers of a year are the vouchers of its months: windows neither overlap nor leave gaps."""
    edges = [f"1997-{month:02d}-01" for month in range(1, 13)] + ["1998-01-01"]
    year = ledger.fund_general_ledger(tables, edges[0], edges[-1]).count()
    months = [
        ledger.fund_general_ledger(tables, first, last).count()
        for first, last in zip(edges, edges[1:])
    ]
    assert year == sum(months) > 0


def test_equal_lines_given_twice_change_the_bag_and_not_the_set(tables):
    doubled = {
        name: tables[name].unionAll(tables[name])
        for name in ("invoice_master_bill_dist", "return_master_bill_dist")
    }
    twice = Tables(lambda name: doubled.get(name, tables[name]))
    window = ("1997-01-01", "1998-01-01")

    def total(report, among, column):
        return only(report(among, *window).agg(F.sum(column)))

    for report, column in (
        (revenue.emergency_revenue, "receivable"),
        (revenue.outpatient_revenue, "total_amt"),
    ):
        assert total(report, twice, column) == total(report, tables, column)
    bag = total(revenue.inpatient_revenue, tables, "receivable")
    assert total(revenue.inpatient_revenue, twice, "receivable") == 2 * bag
