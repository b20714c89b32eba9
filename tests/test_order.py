"""Every report that promises an order keeps it: its keys ascending, NULLs last."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module

# The sort keys each report is defined with.
KEYS = {
    "allowance_deductions": ["description", "month", "mrno"],
    "loan_deductions": ["description", "mrno", "loan_type"],
    "client_receipts": ["receive_date"],
    "client_unadjusted_receipts": ["receive_date"],
    "card_receipts": ["receive_date"],
    "account_codes": ["coa_code"],
    "consumption_analysis": ["store_id"],
    "corporate_billing_monthly": ["subsidiary_code"],
    "corporate_billing_all_years": ["year_code", "subsidiary_code"],
    "panel_inpatient": ["in_setup"],
    "panel_emergency": ["in_setup"],
    "panel_outpatient": ["in_setup"],
    "revenue_dashboard": ["stream", "in_setup"],
    "debtor_aging_open": ["client_id", "final_invoice_date"],
    "debtor_aging_settled": ["client_id", "final_invoice_date"],
    "emergency_revenue": ["adm_department", "in_setup"],
    "inpatient_revenue": ["adm_department", "in_setup"],
    "outpatient_revenue": ["department"],
    "stock_movement_daily": ["transaction_date", "store"],
    "donations_by_location": ["receipt_date"],
    "pharmacy_transfers": ["approved_date"],
    "general_ledger": ["trans_date", "voucher_type", "voucher_no"],
    "fund_general_ledger": ["trans_date", "voucher_type", "voucher_no"],
    "fund_trial_balance": ["coa_code", "coa_description"],
    "referral_letter_amounts": ["ref_letter_trans_date"],
}


def test_no_sorted_report_is_left_out(spark, small_dir):
    for key in set(entry_module.REPORTS) - set(KEYS):
        plan = entry_module.run(key, spark, small_dir)._jdf.queryExecution().optimizedPlan()
        assert not plan.toString().startswith("Sort ["), key


@pytest.mark.parametrize("key", sorted(KEYS))
def test_rows_follow_the_keys(spark, small_dir, key):
    rows = entry_module.run(key, spark, small_dir).select(*KEYS[key]).collect()
    places = [tuple((value is None, value) for value in row) for row in rows]
    ranks = [tuple((missing, "" if missing else value) for missing, value in place) for place in places]
    for before, after in zip(ranks, ranks[1:], strict=False):
        for (b_missing, b), (a_missing, a) in zip(before, after, strict=True):
            if (b_missing, a_missing) == (False, False) and a == b or (b_missing and a_missing):
                continue
            assert a_missing or (not b_missing and b < a), (key, before, after)
            break
