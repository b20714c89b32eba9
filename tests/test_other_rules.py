"""Ledger, stock, donation and payroll rules on hand-written rows."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest

from helpers import rows_of
from wardbook.operators.stock import EXCLUDED_STORE
from wardbook.plans import dashboard, donations, ledger, payroll, stock


def voucher(number, **more):
    return {
        "voucher_type": "JV",
        "voucher_no": number,
        "trans_date": "2024-01-05",
        "voucher_status": "P",
        **more,
    }


def entry(number, code="8001", **more):
    return {
        "voucher_type": "JV",
        "voucher_no": number,
        "coa_code": code,
        "ledger_type_code": "505",
        "sub_ldgr_item_code": 1,
        **more,
    }


SUB_LEDGERS = [
    {
        "sub_ldgr_item_code": 1,
        "sub_ldgr_item_desc": "One",
        "ledger_type_code": "505",
        "location_id": "101",
    }
]


def accounts(*codes):
    return [{"coa_code": code, "coa_description": f"Account {code}"} for code in codes]


def test_general_ledger_keeps_and_fund_ledger_drops_unknown_sub_ledgers(world):
    lines = [entry(1), entry(1, sub_ldgr_item_code=9), entry(1, ledger_type_code="501")]
    books = {"gl_coa": accounts("8001"), "gl_sub_ledgers": SUB_LEDGERS}
    general = world(gl_tran_master=[voucher(1)], gl_tran_detail=lines, **books)
    fund = world(pf_tran_master=[voucher(1)], pf_tran_detail=lines, **books)
    window = ("2024-01-01", "2024-02-01")
    assert ledger.general_ledger(general, *window, "8", "8", "9").count() == 3
    assert ledger.fund_general_ledger(fund, *window).count() == 1


def test_ledger_codes_compare_as_texts(world):
    codes = ["1", "10", "2", "20", "3"]
    tables = world(
        gl_tran_master=[voucher(1)],
        gl_tran_detail=[entry(1, code) for code in codes],
        gl_coa=accounts(*codes),
    )
    window = ("2024-01-01", "2024-02-01")
    assert [
        row[0] for row in rows_of(ledger.general_ledger(tables, *window, "%", "10", "2"), "coa_code")
    ] == ["10", "2"]
    assert [
        row[0] for row in rows_of(ledger.general_ledger(tables, *window, "2", "1", "9"), "coa_code")
    ] == ["2", "20"]
    with pytest.raises(ValueError, match="coa_to"):
        ledger.general_ledger(tables, *window, "2", "1", "")


def test_ledger_window_and_status_are_the_vouchers(world):
    vouchers = [
        voucher(1),
        voucher(2, voucher_status="U"),
        voucher(3, voucher_status="T", trans_date="2024-02-01"),
        voucher(4, voucher_status="T", trans_date="2024-01-31T23:59"),
    ]
    lines = [entry(number, trans_date="2000-01-01") for number in (1, 2, 3, 4)]
    tables = world(gl_tran_master=vouchers, gl_tran_detail=lines, gl_coa=accounts("8001"))
    report = ledger.general_ledger(tables, "2024-01-01", "2024-02-01", "8", "8", "9")
    assert [row[0] for row in rows_of(report, "voucher_no")] == [1, 4]


def balance(**more):
    return {
        "year_code": "2023-24",
        "coa_code": "8001",
        "ledger_type_code": "505",
        "sub_ldgr_item_code": 1,
        "open_dr": 10,
        "open_cr": 4,
        "tran_dr": 3,
        "tran_cr": 1,
        **more,
    }


def test_closing_skips_rows_with_an_unknown_amount(world):
    tables = world(
        gl_opening_balances=[balance(), balance(tran_cr=None), balance(year_code="x")],
        gl_sub_ledgers=SUB_LEDGERS,
        gl_coa=accounts("8001"),
    )
    report = ledger.fund_trial_balance(tables, "2023-24")
    assert rows_of(report, "open_dr", "tran_cr", "closing") == [
        (Decimal("20.00"), Decimal("1.00"), Decimal("8.00"))
    ]


def corporate(world, from_date, to_date, *moments, **more):
    account = ledger.CORPORATE_ACCOUNT
    return world(
        gl_tran_detail=[
            entry(1, account, trans_date=at, dr_amount=5, cr_amount=1) for at in moments
        ],
        gl_opening_balances=[balance(coa_code=account)],
        gl_financial_year=[{"year_code": "2023-24", "from_date": from_date, "to_date": to_date}],
        gl_sub_ledgers=SUB_LEDGERS,
        gl_coa=accounts(account),
        **more,
    )


def test_corporate_billing_counts_whole_days_of_the_fiscal_year(world):
    moments = ["2023-06-30T23:59", "2023-07-01", "2023-07-31T10:00", "2024-06-30T23:59", "2024-07-01"]
    tables = corporate(world, "2023-07-01", "2024-06-30", *moments)
    report = ledger.corporate_billing_monthly(tables, "2023-24")
    assert rows_of(report, "month", "opening_balance", "billing", "receipt") == [
        ("06-2024", Decimal("6.00"), Decimal("5.00"), Decimal("1.00")),
        ("07-2023", Decimal("6.00"), Decimal("10.00"), Decimal("2.00")),
    ]
    assert ledger.corporate_billing_monthly(tables, "2023-24", client="ONE").count() == 2
    assert ledger.corporate_billing_monthly(tables, "2023-24", client="two").count() == 0
    assert ledger.corporate_billing_monthly(tables, "1999-00").count() == 0


def test_corporate_billing_with_fiscal_dates_that_have_a_time(world):
    moments = ["2023-07-01T23:00", "2023-07-02T00:00", "2024-06-30T23:59"]
    tables = corporate(world, "2023-07-01T08:00", "2024-06-30T08:00", *moments)
    report = ledger.corporate_billing_monthly(tables, "2023-24")
    assert rows_of(report, "month", "billing") == [
        ("06-2024", Decimal("5.00")),
        ("07-2023", Decimal("5.00")),
    ]


def test_trial_balance_shows_rows_with_any_amount_for_the_users_terminal(world):
    zero = dict.fromkeys(
        ["year_open_dr", "year_open_cr", "run_open_dr", "run_open_cr", "tran_dr", "tran_cr"], 0
    )
    row = {"coa_code": "1", "user_id": 5, "terminal": "T1", "close_dr": 9, **zero}
    tables = world(
        users=[{"mrno": 7, "userid": 5, "terminal": "T1", "full_name": "U"}],
        gl_trial_sub_ledgers=[
            row,
            {**row, "coa_code": "2", "year_open_cr": -1},
            {**row, "coa_code": "3", "tran_dr": 1, "tran_cr": None},
            {**row, "coa_code": "4", "tran_dr": 1, "terminal": "T2"},
            {**row, "coa_code": "5", "tran_dr": None},
        ],
    )
    assert [r[0] for r in rows_of(ledger.trial_balance_by_user(tables, 7), "coa_code")] == ["2", "3"]
    assert ledger.trial_balance_by_user(tables, 8).count() == 0


def test_account_codes_are_distinct_and_in_use(world):
    coa = [
        {"coa_code": code, "coa_description": "A", "coa_level_code": level, "ledger_type_code": kind}
        for code, level, kind in [("1", "4", "505"), ("1", "4", "505"), ("2", "4", "x"), ("3", "3", "505")]
    ]
    tables = world(gl_coa=coa, gl_sub_ledgers=SUB_LEDGERS * 2)
    assert rows_of(ledger.account_codes(tables)) == [("1", "A")]


def move(**more):
    return {
        "trans_date": "2024-01-05",
        "store_id": "s1",
        "item_id": 9,
        "cost_centre_id": 1,
        "move_type_id": "16",
        "qty_cr": 5,
        "qty_dr": 2,
        "unit_cost": 10,
        **more,
    }


def storeroom(moves, **more):
    return {
        "mms_item_ledger": moves,
        "store": [
            {"store_id": "s1", "description": "Main", "main_sub": "M"},
            {"store_id": "s2", "description": "Sub", "main_sub": "S"},
            {"store_id": EXCLUDED_STORE, "main_sub": "M"},
        ],
        "item": [{"item_id": 9, "description": "Gauze"}],
        "def_move_type": [{"move_type_id": kind} for kind in ("16", "2", "9")],
        "gl_sub_ledgers": SUB_LEDGERS,
        **more,
    }


def test_consumption_nets_and_values_per_cost_centre(world):
    moves = [
        move(),
        move(qty_cr=None, unit_cost=20),
        move(unit_cost=None, qty_dr=None),
        move(move_type_id="9"),
        move(store_id="s2"),
        move(store_id="10110"),
        move(trans_date="2024-02-01"),
    ]
    tables = world(**storeroom(moves))
    report = stock.consumption_analysis(tables, "2024-01-01", "2024-02-01", "101")
    assert rows_of(report, "store", "item", "qty", "value") == [
        ("Main", "Gauze", Decimal("6.00"), Decimal("-10.000000"))
    ]
    assert stock.consumption_analysis(tables, "2024-01-01", "2024-02-01", "9").count() == 0
    figure = stock.kpi_consumption(tables, "2024-01-31")
    assert rows_of(figure) == [(Decimal("9.00"), Decimal("20.000000"))]


def test_consumption_repeats_for_repeated_names(world):
    twice = storeroom([move()], item=[{"item_id": 9, "description": "Gauze"}] * 2)
    report = stock.consumption_analysis(world(**twice), "2024-01-01", "2024-02-01", "101")
    assert rows_of(report, "qty", "value") == [(Decimal("6.00"), Decimal("60.000000"))]


def test_one_unknown_sub_store_empties_consumption(world):
    tables = storeroom([move()])
    tables["store"].append({"store_id": None, "main_sub": "S"})
    report = stock.consumption_analysis(world(**tables), "2024-01-01", "2024-02-01", "101")
    assert report.count() == 0


def test_stock_balance_is_unknown_when_a_side_never_moved(world):
    def moved(item, **sides):
        return {
            "store_id": "s1",
            "transaction_date": "2024-01-05T07:00",
            "item_id": item,
            "transaction_type_id": "026",
            "moving_average_price": 2,
            **sides,
        }

    tables = world(
        inventory_ledger=[
            moved(1, qty_debit=3),
            moved(2, qty_debit=3),
            moved(2, qty_credit=1, transaction_date="2024-01-05T23:59"),
            moved(2, qty_credit=1, transaction_date="2024-01-06"),
        ],
        store=[{"store_id": "s1", "description": "Main", "main_sub": "M"}],
        transaction_type=[{"transaction_type_id": "026", "description": "TRANSFER"}],
        drug_label=[{"item_id": 1, "label": "Gauze"}],
        item_label=[{"item_id": 1, "label": "Another"}, {"item_id": 2, "label": "Another"}],
    )
    report = stock.stock_movement_daily(tables, "2024-01-01", "2024-02-01")
    found = rows_of(report, "transaction_date", "item_id", "item", "debt_value", "balance")
    six = Decimal("6.000000")
    assert found == [
        (datetime(2024, 1, 5), 1, "Gauze", six, None),
        (datetime(2024, 1, 5), 2, None, six, Decimal("4.000000")),
        (datetime(2024, 1, 6), 2, None, None, None),
    ]


def transfers(world, **line):
    stores = [
        {"store_id": "p", "description": "Main Pharmacy"},
        {"store_id": "h", "description": "FMH in house Pharmacy"},
        {"store_id": "w", "description": "Ward"},
    ]
    transfer = {"approved_date": "2025-01-05", "to_store_id": "w", "delivered_by": 3}
    return world(
        store=stores,
        vu_information=[{"mrno": 3}],
        store_transfer_master=[
            {**transfer, "trans_no": 1, "from_store_id": "p"},
            {**transfer, "trans_no": 2, "from_store_id": "h"},
            {**transfer, "trans_no": 3, "from_store_id": "w"},
        ],
        store_transfer_detail=[
            {
                "trans_no": number,
                "item_id": 9,
                "transfered_qty": 2,
                "moving_average_cost": 10,
                "cancel_qty": 1,
                "transaction_type_id": "026",
                **line,
            }
            for number in (1, 2, 3)
        ],
    )


def test_transfers_leave_pharmacies_and_add_what_was_cancelled(world):
    tables = transfers(world)
    report = stock.pharmacy_transfers(tables, "2025-01-01", "2025-02-01")
    assert rows_of(report, "from_store", "to_store", "value", "cancel") == [
        ("FMH in house Pharmacy", "Ward", Decimal("20.000000"), Decimal("10.000000")),
        ("Main Pharmacy", "Ward", Decimal("20.000000"), Decimal("10.000000")),
    ]
    assert rows_of(stock.kpi_pharmacy_consumption(tables)) == [(Decimal("30.000000"),)]
    unknown = transfers(world, cancel_qty=None)
    assert rows_of(stock.kpi_pharmacy_consumption(unknown)) == [(Decimal("0.000000"),)]
    others = transfers(world, transaction_type_id="001")
    assert stock.pharmacy_transfers(others, "2025-01-01", "2025-02-01").count() == 0


def donation(number, **more):
    return {
        "receipt_no": number,
        "receipt_location_id": "101",
        "trans_date": "2024-01-31",
        "donor_id": 4,
        "donor_name": "Donor",
        "donation_type_id": 1,
        "donation_group_id": 2,
        "mode_id": "m",
        "amount": 10,
        **more,
    }


def appeal(*gifts):
    return {
        "donation": list(gifts),
        "donor": [{"donor_id": 4, "mobile": "0300"}],
        "donation_types": [
            {"donation_type_id": 1, "donation_group_id": 2, "description": "Zakat"},
            {"donation_type_id": 1, "donation_group_id": 3, "description": "Other"},
        ],
        "payment_mode": [{"payment_mode_id": "m", "description": "CASH"}],
        "gl_coa": accounts("8001"),
    }


def test_donations_close_their_window_at_midnight(world):
    gifts = [donation(1), donation(2, trans_date="2024-01-31T00:01"), donation(3, donor_id=5)]
    tables = world(**appeal(*gifts))
    window = ("2024-01-01", "2024-01-31")
    assert [r[0] for r in rows_of(donations.donations_report(tables, *window), "receipt_no")] == [1]
    assert donations.donations_by_location(tables, *window, "102").count() == 0
    with pytest.raises(ValueError, match="location"):
        donations.donations_by_location(tables, *window, None)
    assert [r[0] for r in rows_of(donations.donation_receipt_numbers(tables), "receipt_no")] == [1, 2]
    assert rows_of(donations.kpi_donations(tables, "2024-03-01")) == [(Decimal("20.00"),)]


def test_donation_purpose_and_party_fall_back(world):
    gifts = [
        donation(1, coa_code_cr="8001", name_for_other="Friend", address_for_other="Street"),
        donation(2, coa_code_cr="9", donor_address="Home"),
    ]
    tables = world(**appeal(*gifts))
    report = donations.donations_report(tables, "2024-01-01", "2024-01-31", as_of="2024-02-02")
    assert rows_of(report, "party_name", "address", "on_account_of", "printed_on") == [
        ("Donor", "Home", "Zakat", datetime(2024, 2, 2)),
        ("Friend", "Street", "Account 8001", datetime(2024, 2, 2)),
    ]
    assert donations.donation_receipt(tables, 2).count() == 1
    assert donations.donation_receipt(tables, None).count() == 0


def test_empty_party_names_are_unknown_when_asked(world):
    gifts = appeal(donation(1, name_for_other=""))
    plain = donations.donation_receipt_numbers(world(**gifts))
    assert rows_of(plain) == [(1, "")]
    normalised = donations.donation_receipt_numbers(world(empty_as_null=True, **gifts))
    assert rows_of(normalised) == [(1, "Donor")]


def test_allowances_are_a_set_with_a_text_month(world):
    pay = {"location_id": "101", "mrno": 7, "ad_code": "001", "end_date": "2024-04-30"}
    paid = [
        {**pay, "calc_amount": 5},
        {**pay, "calc_amount": 5},
        {**pay, "calc_amount": 5, "end_date": "2024-04-01"},
        {**pay, "calc_amount": 5, "end_date": "2024-01-31"},
        {**pay, "calc_amount": 0},
        {**pay, "calc_amount": 6, "location_id": None},
        {**pay, "calc_amount": 7, "ad_code": "000"},
        {**pay, "calc_amount": 8, "end_date": "2024-04-30T00:01"},
    ]
    employee = {"mrno": 7, "name": "Emp"}
    tables = world(
        pay_allowance_deduction=paid,
        def_allowance_deduction=[
            {"ad_code": "001", "description": "House"},
            {"ad_code": "000", "description": "None"},
        ],
        pay_arrear=[
            {"location_id": "101", "mrno": 7, "arrear_code": "1", "end_date": "2024-02-01", "amount": 9}
        ],
        def_arrear=[{"arrear_code": "1", "description": "Late"}],
        vu_information=[employee, employee, {**employee, "name": "Emp B"}],
    )
    report = payroll.allowance_deductions(tables, "2024-01-01", "2024-04-30")
    found = [(r.description, r.month, r.name, int(r.amount)) for r in report.collect()]
    assert found == [
        ("House", "Apr-24", "Emp", 5),
        ("House", "Apr-24", "Emp B", 5),
        ("House", "Jan-24", "Emp", 5),
        ("House", "Jan-24", "Emp B", 5),
        ("Late", "Feb-24", "Emp", 9),
        ("Late", "Feb-24", "Emp B", 9),
    ]


def test_loans_take_the_employee_of_the_loan_and_the_number_of_the_refund(world):
    refund = {"loan_no": 1, "end_date": "2024-01-31", "mrno": 99, "loan_amount": 9, "refund_amount": 1}
    tables = world(
        loan_refund_detail=[refund, refund, {**refund, "end_date": "2024-01-31T08:00"}],
        loan_payment_master=[{"loan_no": 1, "loan_code": "L", "loan_location_id": "5", "mrno": 7}],
        def_loan_type=[
            {"loan_code": "L", "location_id": "101", "description": "Car"},
            {"loan_code": "L", "location_id": "102", "description": "House"},
        ],
        location=[{"location_id": "5", "description": "Clinic"}],
        v_information=[{"mrno": 7, "name": "Emp"}],
    )
    report = payroll.loan_deductions(tables, "2024-01-01", "2024-01-31")
    assert rows_of(report, "description", "month", "loan_type", "mrno", "name") == [
        ("Clinic", "Jan-24", "Car", 99, "Emp")
    ] * 2


def test_front_page_over_nothing_is_zero_everywhere(world):
    row = dashboard.kpi_dashboard(world(), "2024-01-31").collect()
    assert len(row) == 1 and all(value == 0 for value in row[0]) and len(row[0]) == 7


def test_accounts_are_counted_whole(world):
    users = [{"mrno": 7, "full_name": "U"}, {"mrno": 7, "full_name": "U"}, {"mrno": 8, "full_name": "U"}]
    assert rows_of(dashboard.user_account_counts(world(users=users))) == [(7, "U", 2), (8, "U", 1)]
