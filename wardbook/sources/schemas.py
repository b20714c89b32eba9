"""Declared columns of every source table, grouped by the schema that owns it.

Money is decimal(18,2), unit costs decimal(18,4), codes are strings and dates
carry a time of day, so they are timestamps without a zone.
"""

from __future__ import annotations

# Source schema -> table -> columns.
OWNED_TABLES: dict[str, dict[str, str]] = {
    "billing": {
        "invoice_master": (
            "invoice_no bigint, invoice_date timestamp_ntz, mrno bigint, admission_no bigint, location_id "
            "int, order_location_id bigint, order_type_id bigint, order_no bigint"
        ),
        "invoice_master_bill_dist": (
            "invoice_no bigint, serial_no int, contract_id bigint, item_id bigint, qty decimal(18,2), "
            "amount decimal(18,2), client_id string, income_id bigint, department_id bigint"
        ),
        "return_master": (
            "return_no bigint, invoice_no bigint, return_date timestamp_ntz, mrno bigint, admission_no "
            "bigint, location_id int, order_location_id bigint, order_type_id bigint, order_no bigint"
        ),
        "return_master_bill_dist": (
            "return_no bigint, serial_no int, contract_id bigint, item_id bigint, qty decimal(18,2), "
            "amount decimal(18,2), client_id string, income_id bigint, department_id bigint"
        ),
        "client": (
            "client_id string, name string"
        ),
        "income_setup": (
            "income_id int, income_description string"
        ),
        "final_invoice_master": (
            "final_invoice_no bigint, client_invoice_no bigint, client_id string, mrno bigint, process_id "
            "bigint, final_invoice_date timestamp_ntz, final_invoice_type string, net_receivable "
            "decimal(18,2), received_amount decimal(19,2), admission_no bigint, admission_date "
            "timestamp_ntz"
        ),
        "ref_letter_master": (
            "ref_letter_no bigint, client_ref_no string, trans_date timestamp_ntz, mrno bigint"
        ),
        "cash_receive_master": (
            "receive_no bigint, client_id string, received_by bigint, receive_date timestamp_ntz, "
            "total_amount decimal(18,2), remarks string, sale_id bigint, invoice_no bigint"
        ),
        "cash_receive_detail": (
            "receive_no bigint, payment_mode_id string, instrument_no int, amount decimal(18,2), wht_tax "
            "decimal(18,2), received_amount decimal(19,2), final_invoice_no bigint, merchant_id bigint, "
            "validity_date timestamp_ntz"
        ),
        "cash_refund_master": (
            "receipt_no bigint, client_id string"
        ),
        "payment_mode": (
            "payment_mode_id string, description string"
        ),
        "payment_mode_wise_merchant": (
            "merchant_id bigint, description string"
        ),
        "franchise_cheque": (
            "final_receipt_no bigint, receive_no bigint"
        ),
        "final_receipt_detail2": (
            "final_receipt_no bigint, mrno bigint, invoice_amount decimal(18,2), received_amount "
            "decimal(18,2), adjusted_amount decimal(18,2), adjust_amount decimal(19,2), client_invoice_no "
            "bigint, chk_option string"
        ),
    },
    "orderentry": {
        "order_patient_admission": (
            "mrno bigint, admission_no bigint, doctor_id bigint, order_type_id bigint, order_no bigint, "
            "location_id int, order_location_id bigint, admission_final_time timestamp_ntz, "
            "discharge_date timestamp_ntz, order_admission_type string"
        ),
        "order_master": (
            "order_type_id bigint, order_no bigint, location_id int, order_location_id bigint, "
            "patient_type_id int, reffering_inhouse_doctor_id bigint"
        ),
    },
    "definitions": {
        "patient_type": (
            "patient_type_id int, description string"
        ),
        "v_doctor": (
            "doctor_id bigint, name string, department string"
        ),
        "order_location": (
            "location_id int, order_location_id int, description string"
        ),
        "transaction_type": (
            "transaction_type_id string, description string"
        ),
        "location": (
            "location_id string, description string"
        ),
    },
    "registration": {
        "v_patient": (
            "mrno bigint, name string, nic_new string"
        ),
    },
    "finance": {
        "gl_sub_ledgers": (
            "sub_ldgr_item_code int, sub_ldgr_item_desc string, ledger_type_code string, location_id "
            "string"
        ),
        "pbs_tran_detail_corporate": (
            "process_id bigint, client_id string, final_invoice_no bigint, mrno bigint, admission_no "
            "bigint, ref_letter_no bigint"
        ),
        "pbs_tran_detail": (
            "client_id string, coa_code string, mrno bigint, trans_no bigint, admission_no bigint, "
            "ref_letter_no bigint, dr_amount decimal(18,2), cr_amount decimal(18,2)"
        ),
        "gl_coa": (
            "coa_code string, coa_description string, coa_level_code string, ledger_type_code string"
        ),
        "gl_tran_master": (
            "voucher_type string, voucher_no bigint, trans_date timestamp_ntz, reference_no string, "
            "remarks string, voucher_status string"
        ),
        "gl_tran_detail": (
            "voucher_type string, voucher_no bigint, trans_date timestamp_ntz, coa_code string, "
            "ledger_type_code string, sub_ldgr_item_code bigint, narration string, dr_amount "
            "decimal(18,2), cr_amount decimal(18,2)"
        ),
        "pf_tran_master": (
            "voucher_type string, voucher_no bigint, trans_date timestamp_ntz, reference_no string, "
            "remarks string, voucher_status string"
        ),
        "pf_tran_detail": (
            "voucher_type string, voucher_no bigint, trans_date timestamp_ntz, coa_code string, "
            "ledger_type_code string, sub_ldgr_item_code bigint, narration string, dr_amount "
            "decimal(18,2), cr_amount decimal(18,2)"
        ),
        "gl_financial_year": (
            "year_code string, from_date timestamp_ntz, to_date timestamp_ntz"
        ),
        "gl_opening_balances": (
            "year_code string, coa_code string, ledger_type_code string, sub_ldgr_item_code int, open_dr "
            "decimal(18,2), open_cr decimal(18,2), tran_dr decimal(18,2), tran_cr decimal(18,2)"
        ),
        "gl_trial_sub_ledgers": (
            "coa_code string, coa_description string, ledger_type_code string, sub_ldgr_item_code bigint, "
            "sub_ledger_item_desc string, year_open_dr decimal(18,2), year_open_cr decimal(18,2), "
            "run_open_dr decimal(18,2), run_open_cr decimal(18,2), tran_dr decimal(18,2), tran_cr "
            "decimal(18,2), close_dr decimal(18,2), close_cr decimal(18,2), user_id bigint, terminal "
            "string"
        ),
    },
    "hrd": {
        "vu_information": (
            "mrno bigint, name string, department string, designation string, joining_date timestamp_ntz, "
            "nic string"
        ),
        "v_information": (
            "mrno bigint, name string, department string, designation string, joining_date timestamp_ntz, "
            "nic string"
        ),
    },
    "security": {
        "users": (
            "mrno bigint, full_name string, userid bigint, terminal string"
        ),
    },
    "mms": {
        "mms_item_ledger": (
            "trans_date timestamp_ntz, store_id string, item_id bigint, cost_centre_id bigint, "
            "move_type_id string, qty_cr decimal(18,2), qty_dr decimal(18,2), unit_cost decimal(18,4)"
        ),
        "def_move_type": (
            "move_type_id string"
        ),
        "store_transfer_master": (
            "trans_no bigint, approved_date timestamp_ntz, from_store_id string, to_store_id string, "
            "delivered_by bigint"
        ),
        "store_transfer_detail": (
            "trans_no bigint, item_id bigint, transfered_qty decimal(18,2), moving_average_cost "
            "decimal(18,4), cancel_qty decimal(18,2), transaction_type_id string"
        ),
    },
    "item": {
        "store": (
            "store_id string, description string, main_sub string"
        ),
        "item": (
            "item_id bigint, description string"
        ),
    },
    "pharmacy": {
        "item_label": (
            "item_id bigint, label string"
        ),
        "drug_label": (
            "item_id bigint, label string"
        ),
    },
    "inventory": {
        "inventory_ledger": (
            "store_id string, transaction_date timestamp_ntz, item_id bigint, transaction_type_id string, "
            "qty_debit decimal(18,2), qty_credit decimal(18,2), moving_average_price decimal(18,4)"
        ),
    },
    "marketing": {
        "donation": (
            "receipt_no bigint, receipt_location_id string, trans_date timestamp_ntz, coa_code_cr string, "
            "name_for_other string, donor_name string, address_for_other string, donor_address string, "
            "donor_id bigint, donation_type_id bigint, donation_group_id bigint, mode_id string, "
            "cheque_no string, amount decimal(18,2), remarks string, received_by string"
        ),
        "donor": (
            "donor_id bigint, mobile string"
        ),
        "donation_types": (
            "donation_type_id int, donation_group_id int, description string"
        ),
    },
    "payroll": {
        "def_arrear": (
            "arrear_code string, description string"
        ),
        "pay_arrear": (
            "location_id string, mrno bigint, arrear_code string, end_date timestamp_ntz, amount "
            "decimal(18,2)"
        ),
        "def_allowance_deduction": (
            "ad_code string, description string"
        ),
        "pay_allowance_deduction": (
            "location_id string, mrno bigint, ad_code string, end_date timestamp_ntz, calc_amount "
            "decimal(18,2)"
        ),
        "def_loan_type": (
            "loan_code string, location_id string, description string"
        ),
        "loan_payment_master": (
            "loan_no bigint, loan_code string, loan_location_id string, mrno bigint"
        ),
        "loan_refund_detail": (
            "loan_no bigint, end_date timestamp_ntz, mrno bigint, loan_amount decimal(18,2), "
            "refund_amount decimal(18,2)"
        ),
    },
}

SCHEMAS: dict[str, str] = {
    table: ddl for tables in OWNED_TABLES.values() for table, ddl in tables.items()
}
OWNERS: dict[str, str] = {
    table: owner for owner, tables in OWNED_TABLES.items() for table in tables
}

# Tables that grow with the hospital's work; a database has to be asked for them in parallel ranges.
FACTS = frozenset(
    """
    invoice_master invoice_master_bill_dist return_master return_master_bill_dist order_master
    order_patient_admission final_invoice_master pbs_tran_detail pbs_tran_detail_corporate
    cash_receive_master cash_receive_detail final_receipt_detail2 gl_tran_master gl_tran_detail
    pf_tran_master pf_tran_detail mms_item_ledger inventory_ledger store_transfer_master
    store_transfer_detail donation ref_letter_master
    """.split()
)
