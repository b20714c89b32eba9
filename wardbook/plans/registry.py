"""Every report by its key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from wardbook.plans import dashboard, donations, ledger, payroll, receivables, revenue, stock

_ALL = (
    receivables.client_receipt_adjustment,
    receivables.referral_letter_amounts,
    receivables.debtor_aging_open,
    receivables.debtor_aging_settled,
    ledger.trial_balance_by_user,
    ledger.account_codes,
    ledger.general_ledger,
    payroll.allowance_deductions,
    payroll.loan_deductions,
    stock.consumption_analysis,
    receivables.client_receipts,
    receivables.client_unadjusted_receipts,
    receivables.card_receipts,
    revenue.inpatient_revenue,
    revenue.emergency_revenue,
    revenue.outpatient_revenue,
    donations.donations_by_location,
    donations.donations_report,
    donations.donation_receipt,
    donations.donation_receipt_numbers,
    ledger.corporate_billing_monthly,
    ledger.corporate_billing_all_years,
    stock.stock_movement_daily,
    ledger.fund_general_ledger,
    ledger.fund_trial_balance,
    stock.pharmacy_transfers,
    receivables.kpi_total_receivable,
    stock.kpi_consumption,
    receivables.kpi_client_receipts,
    donations.kpi_donations,
    receivables.kpi_debtor_billing,
    stock.kpi_pharmacy_consumption,
    dashboard.kpi_dashboard,
    revenue.panel_inpatient,
    revenue.panel_emergency,
    revenue.panel_outpatient,
    revenue.revenue_dashboard,
    dashboard.user_account_counts,
)

REPORTS: dict[str, Callable[..., DataFrame]] = {report.__name__: report for report in _ALL}
