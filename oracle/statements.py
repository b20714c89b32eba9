"""Each report as one SQL statement, for checking the Spark results in another engine.

The statements are written from the meaning of the reports, with every join and
every union spelled out and without the rewrites the Spark plans use: repeats
are produced and removed by UNION, lookups are correlated subqueries, and
amounts are summed after all joins.
"""

from __future__ import annotations

import re

from wardbook.sources.fixtures import FIXTURES, fixture_ctes

AS_OF = "TIMESTAMP '2001-07-31 00:00:00'"
SINCE = "TIMESTAMP '2001-07-01 00:00:00'"


def day(text: str) -> str:
    return f"TIMESTAMP '{text} 00:00:00'"


def half_open(column: str, start: str, end: str) -> str:
    return f"{column} >= {day(start)} AND {column} < {day(end)}"


def closed(column: str, start: str, end: str) -> str:
    return f"{column} BETWEEN {day(start)} AND {day(end)}"


JANUARY = ("1997-01-01", "1997-02-01")
YEAR = ("1997-01-01", "1998-01-01")


def branch(returned: bool, setting: str, panel: bool) -> str:
    """One side of a revenue union: invoiced or returned lines of a care setting."""
    doc, lines, key, dated, sign = (
        ("return_master", "return_master_bill_dist", "return_no", "return_date", "-1 *")
        if returned
        else ("invoice_master", "invoice_master_bill_dist", "invoice_no", "invoice_date", "")
    )
    outpatient = setting == "opd"
    optional = "LEFT JOIN" if panel else "JOIN"
    columns = [
        "h.admission_no",
        "l.serial_no",
        "h.return_no" if returned else "CAST(NULL AS BIGINT) AS return_no",
        "h.mrno",
        "pat.name AS pat_name",
        f"h.{dated} AS dated",
        "h.invoice_no",
        "l.item_id",
        "(SELECT il.label FROM item_label il WHERE il.item_id = l.item_id) AS drug",
        f"{sign} l.qty AS qty",
        f"{sign} l.amount AS amount",
        "dr.name AS doctor",
        "dr.department AS department",
        "ty.description AS patient_type",
        "payer.name AS cl_name",
        "inc.income_description AS in_setup",
        "led.sub_ldgr_item_desc AS sub_ldgr_desc",
    ]
    joins = [
        f"FROM {doc} h",
        f"JOIN {lines} l ON l.{key} = h.{key}",
        "JOIN v_patient pat ON pat.mrno = h.mrno",
        f"{optional} client payer ON payer.client_id = l.client_id",
        "JOIN income_setup inc ON inc.income_id = l.income_id",
        f"{optional} gl_sub_ledgers led ON led.sub_ldgr_item_code = l.department_id",
    ]
    ordered = "h" if outpatient else "adm"
    if not outpatient:
        columns += [
            "l.contract_id",
            "l.client_id",
            "l.department_id",
            "adm.admission_final_time",
            "adm.discharge_date",
            "adm.order_admission_type",
            "place.description AS order_location",
        ]
        joins += [
            "JOIN order_patient_admission adm ON adm.mrno = h.mrno AND adm.admission_no = h.admission_no",
            "JOIN order_location place ON place.location_id = h.location_id"
            " AND place.order_location_id = h.order_location_id",
        ]
    joins += [
        f"JOIN order_master ord ON ord.order_type_id = {ordered}.order_type_id"
        f" AND ord.order_no = {ordered}.order_no AND ord.location_id = {ordered}.location_id"
        f" AND ord.order_location_id = {ordered}.order_location_id",
        "JOIN patient_type ty ON ty.patient_type_id = ord.patient_type_id",
        f"{optional} v_doctor dr ON dr.doctor_id = ord.reffering_inhouse_doctor_id"
        if outpatient
        else "JOIN v_doctor dr ON dr.doctor_id = adm.doctor_id",
    ]
    where = []
    if not panel:
        where += [
            "lower(dr.name) LIKE '%'",
            "lower(dr.department) LIKE '%'",
            "lower(led.sub_ldgr_item_desc) LIKE '%'",
            "lower(ty.description) LIKE '%'",
        ]
    if outpatient:
        where += [
            "h.admission_no IS NULL",
            f"h.{dated} >= {SINCE}" if panel else half_open(f"h.{dated}", *YEAR),
        ]
    else:
        described = "place.description" if panel else "upper(place.description)"
        where += [
            f"{described} {'=' if setting == 'ear' else '<>'} 'ADULT/PAEDS-EMERGENCY - FMH'",
            "h.admission_no IS NOT NULL",
        ]
        if panel and setting == "ipd":
            joins.append("JOIN final_invoice_master fin ON fin.admission_no = h.admission_no")
            where.append(f"fin.final_invoice_date >= {SINCE}")
        else:
            window = (
                f"fin.final_invoice_date >= {SINCE}"
                if panel
                else half_open("fin.final_invoice_date", *YEAR)
            )
            where.append(
                f"h.admission_no IN (SELECT fin.admission_no FROM final_invoice_master fin WHERE {window})"
            )
    return "\n".join(
        ["SELECT " + ", ".join(columns), *joins, "WHERE " + "\n  AND ".join(where)]
    )


def revenue(setting: str, union: str, doctor: str, department: str, total: str) -> str:
    return f"""
SELECT doctor AS {doctor}, department AS {department}, sub_ldgr_desc, patient_type, cl_name, in_setup,
       count(DISTINCT invoice_no) AS invoice_count, CAST(sum(amount) AS DECIMAL(28,2)) AS {total}
FROM ({branch(False, setting, False)}
{union}
{branch(True, setting, False)}) every_line
GROUP BY ALL"""


def panel(setting: str, total: str = "amount") -> str:
    return f"""
SELECT in_setup, CAST(sum(amount) AS DECIMAL(28,2)) AS {total}
FROM ({branch(False, setting, True)}
UNION ALL
{branch(True, setting, True)}) every_line
GROUP BY in_setup"""


def stay_lookups(invoice: str, patient: str) -> str:
    """The three correlated lookups of the aging reports."""
    same = (
        f"det.process_id = {invoice}.process_id AND det.client_id = {invoice}.client_id"
        f" AND det.final_invoice_no = {invoice}.client_invoice_no AND det.mrno = {patient}.mrno"
    )
    return f"""
  (SELECT min(let.client_ref_no) FROM pbs_tran_detail_corporate det
   JOIN ref_letter_master let ON let.ref_letter_no = det.ref_letter_no WHERE {same}) AS ref_letter_no,
  (SELECT max(det.admission_no) FROM pbs_tran_detail_corporate det WHERE {same}) AS admission_no,
  (SELECT max(other.admission_date) FROM pbs_tran_detail_corporate det
   JOIN final_invoice_master other ON other.admission_no = det.admission_no AND other.mrno = det.mrno
   WHERE {same}) AS admission_date"""


OPEN_INVOICES = f"""
FROM final_invoice_master inv
JOIN client payer ON payer.client_id = inv.client_id
JOIN v_patient pat ON pat.mrno = inv.mrno
WHERE coalesce(abs(inv.net_receivable), 0) - coalesce(inv.received_amount, 0) > 0
  AND inv.final_invoice_type IN ('I', 'O', 'H')
  AND inv.client_invoice_no IN (
    SELECT up.final_invoice_no FROM final_invoice_master up
    WHERE coalesce(up.net_receivable, 0) > coalesce(up.received_amount, 0)
      AND up.final_invoice_type IN ('R', 'H') AND up.final_invoice_date > {day('1996-01-01')})"""

REMAINING = "coalesce(inv.net_receivable, 0) - coalesce(inv.received_amount, 0)"

REFUNDED = "SELECT ref.receipt_no FROM cash_refund_master ref WHERE ref.client_id IS NOT NULL"

CLIENT_RECEIPTS = f"""
FROM cash_receive_master rec
JOIN cash_receive_detail pay ON pay.receive_no = rec.receive_no
JOIN client payer ON payer.client_id = rec.client_id
JOIN vu_information staff ON staff.mrno = rec.received_by
JOIN payment_mode mode ON mode.payment_mode_id = pay.payment_mode_id
WHERE rec.receive_no NOT IN ({REFUNDED})"""

DONATIONS = """
FROM donation gift
JOIN donor giver ON giver.donor_id = gift.donor_id
JOIN donation_types kind ON kind.donation_type_id = gift.donation_type_id
  AND kind.donation_group_id = gift.donation_group_id
JOIN payment_mode mode ON mode.payment_mode_id = gift.mode_id
LEFT JOIN gl_coa acc ON acc.coa_code = gift.coa_code_cr
WHERE gift.receipt_location_id = '101'"""

DONATION_COLUMNS = f"""
SELECT gift.receipt_no, gift.receipt_location_id, gift.trans_date AS receipt_date, gift.coa_code_cr,
  coalesce(gift.name_for_other, gift.donor_name) AS party_name,
  coalesce(gift.address_for_other, gift.donor_address) AS address,
  coalesce(acc.coa_description, (SELECT k.description FROM donation_types k
    WHERE k.donation_type_id = gift.donation_type_id
      AND k.donation_group_id = gift.donation_group_id)) AS on_account_of,
  mode.description AS mode_of_payment, gift.cheque_no, gift.amount, gift.remarks,
  gift.received_by AS cashier, {AS_OF} AS printed_on, giver.mobile"""


def vouchers(masters: str, details: str, prefix: str, sub_ledgers: str) -> str:
    return f"""
SELECT v.voucher_type, v.voucher_no, v.trans_date, v.reference_no AS cheque_no,
  v.remarks AS voucher_remarks, e.coa_code, acc.coa_description, e.ledger_type_code,
  e.sub_ldgr_item_code, led.sub_ldgr_item_desc, e.narration, e.dr_amount, e.cr_amount
FROM {details} e
JOIN {masters} v ON v.voucher_type = e.voucher_type AND v.voucher_no = e.voucher_no
JOIN gl_coa acc ON acc.coa_code = e.coa_code
{sub_ledgers} gl_sub_ledgers led ON led.ledger_type_code = e.ledger_type_code
  AND led.sub_ldgr_item_code = e.sub_ldgr_item_code
WHERE {half_open('v.trans_date', *YEAR)} AND v.voucher_status IN ('P', 'T') AND e.coa_code LIKE '{prefix}%'"""


def consumed(window: str) -> str:
    return f"""
FROM mms_item_ledger mv
JOIN store st ON st.store_id = mv.store_id
JOIN item it ON it.item_id = mv.item_id
JOIN def_move_type mt ON mt.move_type_id = mv.move_type_id
JOIN gl_sub_ledgers cc ON cc.sub_ldgr_item_code = mv.cost_centre_id
WHERE {window} AND cc.ledger_type_code = '505' AND cc.location_id = '101'
  AND mv.move_type_id IN ('16', '2') AND mv.store_id <> '10110'
  AND mv.store_id NOT IN (SELECT sub.store_id FROM store sub WHERE sub.main_sub = 'S')"""


NET_QTY = "coalesce(mv.qty_cr, 0) - coalesce(mv.qty_dr, 0)"


def transferred(pattern: str) -> str:
    return f"""
FROM store_transfer_master tr
JOIN store_transfer_detail ln ON ln.trans_no = tr.trans_no
JOIN store src ON src.store_id = tr.from_store_id
JOIN store dst ON dst.store_id = tr.to_store_id
JOIN vu_information carrier ON carrier.mrno = tr.delivered_by
WHERE upper(src.description) LIKE '{pattern}' AND {half_open('tr.approved_date', *JANUARY)}
  AND ln.transaction_type_id = '026'"""


PAYMENT = """staff.name, staff.department, staff.designation"""


def kpis() -> dict[str, str]:
    return {
        "kpi_total_receivable": f"""
SELECT CAST(coalesce(sum({REMAINING}), 0) AS DECIMAL(28,2)) AS total_receivable {OPEN_INVOICES}""",
        "kpi_consumption": f"""
SELECT CAST(coalesce(sum({NET_QTY}), 0) AS DECIMAL(28,2)) AS consumption_qty,
  CAST(coalesce(sum(({NET_QTY}) * mv.unit_cost), 0) AS DECIMAL(38,6)) AS consumption_value
{consumed(f"mv.trans_date >= {SINCE}")}""",
        "kpi_client_receipts": f"""
SELECT CAST(coalesce(sum(pay.amount + coalesce(pay.wht_tax, 0)), 0) AS DECIMAL(28,2)) AS gross_amount
{CLIENT_RECEIPTS} AND rec.receive_date >= {SINCE}""",
        "kpi_donations": f"""
SELECT CAST(coalesce(sum(gift.amount), 0) AS DECIMAL(28,2)) AS donation_amount
{DONATIONS} AND gift.trans_date >= {SINCE}""",
        "kpi_debtor_billing": f"""
SELECT CAST(coalesce(sum(inv.net_receivable), 0) AS DECIMAL(28,2)) AS billing
FROM final_invoice_master inv
WHERE inv.final_invoice_type IN ('R', 'H') AND inv.final_invoice_date >= {SINCE}""",
        "kpi_pharmacy_consumption": f"""
SELECT CAST(coalesce(sum(ln.moving_average_cost * ln.transfered_qty)
  + sum(ln.moving_average_cost * ln.cancel_qty), 0) AS DECIMAL(38,6)) AS total_con
{transferred('%FMH IN HOUSE%')}""",
    }


def bodies() -> dict[str, str]:
    figures = kpis()
    return {
        "client_receipt_adjustment": """
SELECT rec.client_id,
  (SELECT min(c.name) FROM client c WHERE c.client_id = rec.client_id) AS client_name,
  (SELECT min(p.name) FROM v_patient p WHERE p.mrno = adj.mrno) AS patient_name,
  adj.mrno, adj.invoice_amount AS bill_amount,
  CAST(coalesce(adj.received_amount, 0) AS DECIMAL(28,2)) AS received_amount,
  CAST(adj.invoice_amount - coalesce(adj.received_amount, 0) AS DECIMAL(28,2)) AS remaining_amount,
  adj.adjusted_amount, adj.adjust_amount, adj.client_invoice_no, adj.final_receipt_no, rec.receive_no,
  rec.total_amount AS cash_receive_amount, rec.receive_date
FROM franchise_cheque chq
JOIN final_receipt_detail2 adj ON adj.final_receipt_no = chq.final_receipt_no
JOIN cash_receive_master rec ON rec.receive_no = chq.receive_no
WHERE adj.chk_option = 'Y'""",
        "referral_letter_amounts": """
SELECT e.client_id, payer.name AS client_name, e.mrno, pat.name, e.trans_no, e.admission_no,
  e.ref_letter_no, let.client_ref_no, let.trans_date AS ref_letter_trans_date,
  CAST(sum(e.dr_amount - e.cr_amount) AS DECIMAL(28,2)) AS amount
FROM pbs_tran_detail e
JOIN client payer ON payer.client_id = e.client_id
JOIN ref_letter_master let ON let.ref_letter_no = e.ref_letter_no
JOIN v_patient pat ON pat.mrno = let.mrno
WHERE e.client_id = '1012000041' AND e.coa_code = '911010'
GROUP BY ALL""",
        "debtor_aging_open": f"""
SELECT inv.client_id, payer.name AS client_name, inv.process_id, inv.final_invoice_date,
  inv.client_invoice_no, {stay_lookups('inv', 'pat')}, inv.mrno, pat.nic_new,
  pat.name AS patient_name, inv.net_receivable, inv.received_amount,
  CAST({REMAINING} AS DECIMAL(28,2)) AS remaining, inv.final_invoice_type, inv.final_invoice_no
{OPEN_INVOICES}""",
        "debtor_aging_settled": f"""
SELECT inv.client_id, payer.name AS client_name, inv.process_id, inv.final_invoice_date,
  inv.client_invoice_no, {stay_lookups('inv', 'pat')}, inv.mrno, pat.nic_new,
  pat.name AS patient_name, inv.net_receivable, inv.received_amount,
  CAST({REMAINING} AS DECIMAL(28,2)) AS remaining
FROM final_invoice_master inv
JOIN client payer ON payer.client_id = inv.client_id
JOIN v_patient pat ON pat.mrno = inv.mrno
WHERE abs(round({REMAINING})) = 0
  AND (inv.process_id, inv.client_id) IN (SELECT d.process_id, d.client_id FROM pbs_tran_detail_corporate d)""",
        "trial_balance_by_user": """
SELECT b.coa_code, b.coa_description, b.ledger_type_code, b.sub_ldgr_item_code, b.sub_ledger_item_desc,
  b.run_open_dr, b.run_open_cr, b.tran_dr, b.tran_cr, b.close_dr, b.close_cr, b.user_id, b.terminal, who.mrno
FROM gl_trial_sub_ledgers b
JOIN users who ON who.userid = b.user_id AND who.terminal = b.terminal
WHERE who.mrno = 7 AND NOT (coalesce(b.year_open_dr, 0) = 0 AND coalesce(b.year_open_cr, 0) = 0
  AND coalesce(b.run_open_dr, 0) = 0 AND coalesce(b.run_open_cr, 0) = 0
  AND coalesce(b.tran_dr, 0) = 0 AND coalesce(b.tran_cr, 0) = 0)""",
        "account_codes": """
SELECT DISTINCT acc.coa_code, acc.coa_description
FROM gl_coa acc JOIN gl_sub_ledgers led ON led.ledger_type_code = acc.ledger_type_code
WHERE acc.coa_level_code = '4'""",
        "general_ledger": vouchers("gl_tran_master", "gl_tran_detail", "2", "LEFT JOIN")
        + " AND e.coa_code BETWEEN '200000000' AND '299999999'",
        "allowance_deductions": f"""
SELECT a.location_id, a.mrno, {PAYMENT}, def.arrear_code AS code, def.description,
  strftime(a.end_date, '%b-%y') AS month, a.amount, staff.joining_date, staff.nic
FROM pay_arrear a
JOIN def_arrear def ON def.arrear_code = a.arrear_code
JOIN vu_information staff ON staff.mrno = a.mrno
WHERE a.amount > 0 AND a.location_id = a.location_id AND {closed('a.end_date', '1997-01-01', '1997-03-31')}
UNION
SELECT a.location_id, a.mrno, {PAYMENT}, def.ad_code, def.description,
  strftime(a.end_date, '%b-%y'), a.calc_amount, staff.joining_date, staff.nic
FROM pay_allowance_deduction a
JOIN def_allowance_deduction def ON def.ad_code = a.ad_code
JOIN vu_information staff ON staff.mrno = a.mrno
WHERE a.calc_amount > 0 AND def.ad_code <> '000' AND a.location_id = a.location_id
  AND {closed('a.end_date', '1997-01-01', '1997-03-31')}""",
        "loan_deductions": f"""
SELECT place.description, r.end_date, strftime(r.end_date, '%b-%y') AS month, kind.description AS loan_type,
  r.mrno, staff.name, staff.designation, staff.department, r.loan_amount, r.refund_amount
FROM loan_refund_detail r
JOIN loan_payment_master loan ON loan.loan_no = r.loan_no
JOIN def_loan_type kind ON kind.loan_code = loan.loan_code
JOIN location place ON place.location_id = loan.loan_location_id
JOIN v_information staff ON staff.mrno = loan.mrno
WHERE kind.location_id = '101' AND {closed('r.end_date', '1997-01-01', '1997-03-31')}""",
        "consumption_analysis": f"""
SELECT cc.location_id, mv.move_type_id, mv.store_id, st.description AS store, mv.cost_centre_id,
  cc.sub_ldgr_item_desc, mv.item_id, it.description AS item, CAST(sum({NET_QTY}) AS DECIMAL(28,2)) AS qty,
  CAST(sum(({NET_QTY}) * mv.unit_cost) AS DECIMAL(38,6)) AS value
{consumed(half_open('mv.trans_date', *JANUARY))}
GROUP BY cc.location_id, mv.move_type_id, mv.store_id, st.description, mv.cost_centre_id,
  cc.sub_ldgr_item_desc, mv.item_id, it.description""",
        "client_receipts": f"""
SELECT rec.receive_date, rec.received_by, staff.name AS received_by_name, rec.receive_no,
  mode.description AS payment_mode, pay.instrument_no, pay.amount AS net_amount, pay.wht_tax,
  CAST(pay.amount + coalesce(pay.wht_tax, 0) AS DECIMAL(28,2)) AS gross_amount, rec.client_id,
  payer.name AS client, pay.final_invoice_no, rec.remarks
{CLIENT_RECEIPTS} AND {half_open('rec.receive_date', *JANUARY)}""",
        "client_unadjusted_receipts": f"""
SELECT payer.client_id, payer.name, rec.receive_date, rec.receive_no, pay.instrument_no,
  CAST(sum(coalesce(pay.amount, 0) + coalesce(pay.wht_tax, 0) - coalesce(pay.received_amount, 0))
    AS DECIMAL(28,2)) AS amount
FROM cash_receive_master rec
JOIN client payer ON payer.client_id = rec.client_id
JOIN cash_receive_detail pay ON pay.receive_no = rec.receive_no
WHERE upper(payer.name) NOT LIKE '%FUND%' AND upper(payer.name) NOT LIKE '%NEPHRO%'
  AND upper(payer.name) NOT LIKE '%HAMD%'
  AND coalesce(pay.amount, 0) + coalesce(pay.wht_tax, 0) - coalesce(pay.received_amount, 0) > 50
  AND rec.receive_no NOT IN ({REFUNDED})
GROUP BY payer.client_id, payer.name, rec.receive_date, rec.receive_no, pay.instrument_no""",
        "card_receipts": f"""
SELECT rec.receive_date, rec.sale_id, rec.invoice_no, pay.receive_no, pay.amount, shop.description,
  pay.instrument_no, pay.validity_date
FROM cash_receive_master rec
JOIN cash_receive_detail pay ON pay.receive_no = rec.receive_no
JOIN payment_mode_wise_merchant shop ON shop.merchant_id = pay.merchant_id
WHERE pay.payment_mode_id = '001006' AND {half_open('rec.receive_date', *JANUARY)}""",
        "inpatient_revenue": revenue(
            "ipd", "UNION ALL", "adm_doctor", "adm_department", "receivable"
        ),
        "emergency_revenue": revenue("ear", "UNION", "adm_doctor", "adm_department", "receivable"),
        "outpatient_revenue": revenue("opd", "UNION", "doctor", "department", "total_amt"),
        "donations_by_location": f"""{DONATION_COLUMNS} {DONATIONS}
  AND {closed('gift.trans_date', '1997-01-01', '1997-01-31')}""",
        "donations_report": f"""{DONATION_COLUMNS} {DONATIONS}
  AND {closed('gift.trans_date', '1997-01-01', '1997-01-31')}""",
        "donation_receipt": f"{DONATION_COLUMNS} {DONATIONS} AND gift.receipt_no = 42",
        "donation_receipt_numbers": f"""
SELECT gift.receipt_no, coalesce(gift.name_for_other, gift.donor_name) AS party_name {DONATIONS}""",
        "corporate_billing_monthly": """
SELECT strftime(e.trans_date, '%m-%Y') AS month, e.coa_code, acc.coa_description,
  e.sub_ldgr_item_code AS subsidiary_code, led.sub_ldgr_item_desc AS client,
  CAST(ob.open_dr - ob.open_cr AS DECIMAL(28,2)) AS opening_balance,
  CAST(sum(e.dr_amount) AS DECIMAL(28,2)) AS billing, CAST(sum(e.cr_amount) AS DECIMAL(28,2)) AS receipt
FROM gl_tran_detail e
JOIN gl_opening_balances ob ON ob.coa_code = e.coa_code AND ob.ledger_type_code = e.ledger_type_code
  AND ob.sub_ldgr_item_code = e.sub_ldgr_item_code
JOIN gl_financial_year yr ON yr.year_code = ob.year_code
  AND date_trunc('day', e.trans_date) BETWEEN yr.from_date AND yr.to_date
JOIN gl_coa acc ON acc.coa_code = e.coa_code
JOIN gl_sub_ledgers led ON led.ledger_type_code = e.ledger_type_code
  AND led.sub_ldgr_item_code = e.sub_ldgr_item_code
WHERE e.coa_code = '1113116004' AND ob.year_code = '1997-1998' AND lower(led.sub_ldgr_item_desc) LIKE '%'
GROUP BY strftime(e.trans_date, '%m-%Y'), e.coa_code, acc.coa_description, e.ledger_type_code,
  e.sub_ldgr_item_code, led.sub_ldgr_item_desc, ob.open_dr - ob.open_cr""",
        "corporate_billing_all_years": """
SELECT yr.year_code, strftime(e.trans_date, '%m-%Y') AS month, e.coa_code, acc.coa_description,
  e.sub_ldgr_item_code AS subsidiary_code, led.sub_ldgr_item_desc AS client,
  CAST(ob.open_dr - ob.open_cr AS DECIMAL(28,2)) AS opening_balance,
  CAST(sum(e.dr_amount) AS DECIMAL(28,2)) AS billing, CAST(sum(e.cr_amount) AS DECIMAL(28,2)) AS receipt
FROM gl_tran_detail e
JOIN gl_financial_year yr ON date_trunc('day', e.trans_date) BETWEEN yr.from_date AND yr.to_date
JOIN gl_opening_balances ob ON ob.year_code = yr.year_code AND ob.coa_code = e.coa_code
  AND ob.ledger_type_code = e.ledger_type_code AND ob.sub_ldgr_item_code = e.sub_ldgr_item_code
JOIN gl_coa acc ON acc.coa_code = e.coa_code
JOIN gl_sub_ledgers led ON led.ledger_type_code = e.ledger_type_code
  AND led.sub_ldgr_item_code = e.sub_ldgr_item_code
WHERE e.coa_code = '1113116004' AND lower(led.sub_ldgr_item_desc) LIKE '%'
GROUP BY yr.year_code, strftime(e.trans_date, '%m-%Y'), e.coa_code, acc.coa_description, e.ledger_type_code,
  e.sub_ldgr_item_code, led.sub_ldgr_item_desc, ob.open_dr - ob.open_cr""",
        "stock_movement_daily": f"""
SELECT mv.store_id, st.description AS store, CAST(date_trunc('day', mv.transaction_date) AS TIMESTAMP)
    AS transaction_date, mv.item_id,
  (SELECT min(lab.label) FROM drug_label lab WHERE lab.item_id = mv.item_id) AS item,
  mv.transaction_type_id, kind.description,
  CAST(sum(mv.qty_debit) AS DECIMAL(28,2)) AS qty_debit,
  CAST(sum(mv.qty_debit * mv.moving_average_price) AS DECIMAL(38,6)) AS debt_value,
  CAST(sum(mv.qty_credit) AS DECIMAL(28,2)) AS qty_credit,
  CAST(sum(mv.qty_credit * mv.moving_average_price) AS DECIMAL(38,6)) AS credit_value,
  CAST(sum(mv.qty_debit * mv.moving_average_price) - sum(mv.qty_credit * mv.moving_average_price)
    AS DECIMAL(38,6)) AS balance
FROM inventory_ledger mv
JOIN transaction_type kind ON kind.transaction_type_id = mv.transaction_type_id
JOIN store st ON st.store_id = mv.store_id
WHERE st.main_sub = 'M' AND {half_open('mv.transaction_date', *JANUARY)}
GROUP BY ALL""",
        "fund_general_ledger": vouchers("pf_tran_master", "pf_tran_detail", "8", "JOIN"),
        "fund_trial_balance": """
SELECT ob.coa_code, acc.coa_description, ob.sub_ldgr_item_code, led.sub_ldgr_item_desc,
  CAST(sum(ob.open_dr) AS DECIMAL(28,2)) AS open_dr, CAST(sum(ob.open_cr) AS DECIMAL(28,2)) AS open_cr,
  CAST(sum(ob.tran_dr) AS DECIMAL(28,2)) AS tran_dr, CAST(sum(ob.tran_cr) AS DECIMAL(28,2)) AS tran_cr,
  CAST(sum(ob.open_dr - ob.open_cr + ob.tran_dr - ob.tran_cr) AS DECIMAL(28,2)) AS closing
FROM gl_opening_balances ob
JOIN gl_sub_ledgers led ON led.ledger_type_code = ob.ledger_type_code
  AND led.sub_ldgr_item_code = ob.sub_ldgr_item_code
JOIN gl_coa acc ON acc.coa_code = ob.coa_code
WHERE ob.year_code = '1997-1998' AND ob.coa_code LIKE '8%'
GROUP BY ob.coa_code, acc.coa_description, ob.sub_ldgr_item_code, led.sub_ldgr_item_desc""",
        "pharmacy_transfers": f"""
SELECT tr.trans_no, tr.approved_date, src.description AS from_store, dst.description AS to_store, ln.item_id,
  (SELECT min(lab.label) FROM item_label lab WHERE lab.item_id = ln.item_id) AS drug, ln.transfered_qty,
  CAST(ln.moving_average_cost * ln.transfered_qty AS DECIMAL(38,6)) AS value, ln.cancel_qty,
  CAST(ln.moving_average_cost * ln.cancel_qty AS DECIMAL(38,6)) AS cancel
{transferred('%PHARM%')}""",
        **figures,
        "kpi_dashboard": f"""
SELECT receivable.total_receivable, used.consumption_qty AS consumption_quantity, used.consumption_value,
  receipts.gross_amount AS client_receipts, gifts.donation_amount AS donations,
  billed.billing AS total_debtor_billing, pharmacy.total_con AS pharmacy_consumption
FROM ({figures['kpi_total_receivable']}) receivable, ({figures['kpi_consumption']}) used,
  ({figures['kpi_client_receipts']}) receipts, ({figures['kpi_donations']}) gifts,
  ({figures['kpi_debtor_billing']}) billed, ({figures['kpi_pharmacy_consumption']}) pharmacy""",
        "rolling_figures": f"""
SELECT 'client_receipts' AS figure, CAST(NULL AS DECIMAL(28,2)) AS quantity,
  CAST(gross_amount AS DECIMAL(38,6)) AS amount FROM ({figures['kpi_client_receipts']}) r
UNION ALL SELECT 'consumption', consumption_qty, consumption_value FROM ({figures['kpi_consumption']}) c
UNION ALL SELECT 'debtor_billing', NULL, CAST(billing AS DECIMAL(38,6)) FROM ({figures['kpi_debtor_billing']}) b
UNION ALL SELECT 'donations', NULL, CAST(donation_amount AS DECIMAL(38,6)) FROM ({figures['kpi_donations']}) d""",
        "panel_inpatient": panel("ipd"),
        "panel_emergency": panel("ear"),
        "panel_outpatient": panel("opd", "total_amt"),
        "revenue_dashboard": f"""
SELECT 'ipd_revenue' AS stream, in_setup, amount FROM ({panel('ipd')}) ipd
UNION ALL SELECT 'ear_revenue', in_setup, amount FROM ({panel('ear')}) ear
UNION ALL SELECT 'opd_revenue', in_setup, amount FROM ({panel('opd')}) opd""",
        "user_account_counts": """
SELECT mrno, full_name, count(*) AS user_count FROM users GROUP BY mrno, full_name""",
    }


def statements() -> dict[str, str]:
    """Report key to a self-contained statement over the test tables."""
    complete = {}
    for key, body in bodies().items():
        words = set(re.findall(r"\w+", body))
        used = [name for name in FIXTURES if name in words]
        complete[key] = f"WITH {fixture_ctes(used)}\n{body.strip()}"
    return complete
