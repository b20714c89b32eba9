"""Revenue rules on hand-written rows."""

from __future__ import annotations

from copy import deepcopy
from decimal import Decimal

import pytest

from wardbook.operators.billing import EMERGENCY
from wardbook.plans import revenue
from helpers import rows_of

WINDOW = ("2024-01-01", "2024-02-01")
AS_OF = "2024-01-31"
ORDER = {"order_type_id": 1, "order_no": 5, "location_id": 101, "order_location_id": 1}


def ward(**changes):
    """One admitted patient with one invoice line of 100 and all names in place."""
    tables = {
        "invoice_master": [
            {
                "invoice_no": 1,
                "invoice_date": "2024-01-10",
                "mrno": 7,
                "admission_no": 70,
                **ORDER,
            }
        ],
        "invoice_master_bill_dist": [line(1)],
        "order_patient_admission": [{"mrno": 7, "admission_no": 70, "doctor_id": 3, **ORDER}],
        "order_master": [{**ORDER, "patient_type_id": 2, "reffering_inhouse_doctor_id": 3}],
        "patient_type": [{"patient_type_id": 2, "description": "Panel"}],
        "v_doctor": [{"doctor_id": 3, "name": "Dr Gray", "department": "Surgery"}],
        "v_patient": [{"mrno": 7, "name": "Pat"}],
        "client": [{"client_id": "c1", "name": "Payer"}],
        "income_setup": [{"income_id": 4, "income_description": "Theatre"}],
        "gl_sub_ledgers": [sub_ledger()],
        "order_location": [
            {"location_id": 101, "order_location_id": 1, "description": "Ward A"},
            {"location_id": 101, "order_location_id": 2, "description": EMERGENCY},
            {"location_id": 101, "order_location_id": 3, "description": EMERGENCY.lower()},
        ],
        "final_invoice_master": [final()],
    }
    tables.update(changes)
    return deepcopy(tables)


def line(number, amount=100, **more):
    return {
        "invoice_no": number,
        "serial_no": 1,
        "contract_id": 1,
        "item_id": 9,
        "qty": 2,
        "amount": amount,
        "client_id": "c1",
        "income_id": 4,
        "department_id": 11,
        **more,
    }


def sub_ledger(kind="505", text="Theatres"):
    return {"sub_ldgr_item_code": 11, "sub_ldgr_item_desc": text, "ledger_type_code": kind}


def final(when="2024-01-15", admission=70):
    return {"final_invoice_no": 500, "final_invoice_date": when, "admission_no": admission}


def at_emergency(tables, place=2):
    for name in ("invoice_master", "order_patient_admission", "order_master"):
        tables[name][0]["order_location_id"] = place
    return tables


def as_outpatient(tables):
    tables["invoice_master"][0]["admission_no"] = None
    return tables


def with_return(tables, amount=40):
    header = dict(tables["invoice_master"][0])
    header.pop("invoice_date")
    tables["return_master"] = [{**header, "return_no": 90, "return_date": "2024-01-20"}]
    returned = line(1, amount)
    returned.pop("invoice_no")
    tables["return_master_bill_dist"] = [{**returned, "return_no": 90}]
    return tables


def totals(report, amount):
    return [tuple(row) for row in report.select("invoice_count", amount).collect()]


def money(*amounts):
    return [(1, Decimal(f"{amount:.2f}")) for amount in amounts]


def test_inpatient_line_is_found_by_its_final_invoice_window(world):
    found = revenue.inpatient_revenue(world(**ward()), *WINDOW)
    assert rows_of(found) == [
        ("Dr Gray", "Surgery", "Theatres", "Panel", "Payer", "Theatre", 1, Decimal("100.00"))
    ]
    on_end = ward(final_invoice_master=[final("2024-02-01")])
    assert revenue.inpatient_revenue(world(**on_end), *WINDOW).count() == 0
    on_start = ward(final_invoice_master=[final("2024-01-01")])
    assert revenue.inpatient_revenue(world(**on_start), *WINDOW).count() == 1


def test_returns_are_subtracted_and_share_the_invoice(world):
    tables = world(**with_return(ward()))
    assert totals(revenue.inpatient_revenue(tables, *WINDOW), "receivable") == money(60)
    assert rows_of(revenue.panel_inpatient(tables, AS_OF)) == [("Theatre", Decimal("60.00"))]


def test_returns_alone_are_negative(world):
    tables = with_return(ward())
    tables["invoice_master_bill_dist"] = []
    assert totals(revenue.inpatient_revenue(world(**tables), *WINDOW), "receivable") == money(-40)


def test_bag_keeps_equal_lines_and_set_drops_them(world):
    twice = [line(1), line(1)]
    bag = revenue.inpatient_revenue(world(**ward(invoice_master_bill_dist=twice)), *WINDOW)
    assert totals(bag, "receivable") == money(200)
    emergency = at_emergency(ward(invoice_master_bill_dist=twice))
    once = revenue.emergency_revenue(world(**emergency), *WINDOW)
    assert totals(once, "receivable") == money(100)
    out = as_outpatient(ward(invoice_master_bill_dist=twice))
    assert totals(revenue.outpatient_revenue(world(**out), *WINDOW), "total_amt") == money(100)


def test_an_invoice_and_a_return_of_minus_the_same_are_different_lines(world):
    tables = with_return(at_emergency(ward()), amount=-100)
    tables["return_master"][0]["return_no"] = 1
    tables["return_master_bill_dist"][0]["return_no"] = 1
    tables["return_master_bill_dist"][0]["qty"] = -2
    report = revenue.emergency_revenue(world(**tables), *WINDOW)
    assert totals(report, "receivable") == money(200)


def test_outpatient_set_ignores_contract_and_codes_behind_equal_names(world):
    lines = [line(1), line(1, contract_id=2), line(1, client_id="c2")]
    clients = [{"client_id": "c1", "name": "Payer"}, {"client_id": "c2", "name": "Payer"}]
    out = as_outpatient(ward(invoice_master_bill_dist=lines, client=clients))
    assert totals(revenue.outpatient_revenue(world(**out), *WINDOW), "total_amt") == money(100)
    er = at_emergency(ward(invoice_master_bill_dist=lines, client=clients))
    assert totals(revenue.emergency_revenue(world(**er), *WINDOW), "receivable") == money(300)


def test_set_repeats_a_line_for_every_patient_name_and_stay_detail(world):
    names = [{"mrno": 7, "name": "Pat"}, {"mrno": 7, "name": "Patricia"}, {"mrno": 7, "name": "Pat"}]
    report = revenue.emergency_revenue(world(**at_emergency(ward(v_patient=names))), *WINDOW)
    assert totals(report, "receivable") == money(200)
    out = as_outpatient(ward(v_patient=names))
    assert totals(revenue.outpatient_revenue(world(**out), *WINDOW), "total_amt") == money(200)
    stay = {"mrno": 7, "admission_no": 70, "doctor_id": 3, **ORDER}
    stays = [stay, {**stay, "discharge_date": "2024-01-12"}, stay]
    tables = at_emergency(ward(order_patient_admission=stays))
    for row in tables["order_patient_admission"]:
        row["order_location_id"] = 2
    report = revenue.emergency_revenue(world(**tables), *WINDOW)
    assert totals(report, "receivable") == money(200)


def test_sub_ledger_is_found_by_code_alone(world):
    same_text = [sub_ledger("505"), sub_ledger("501")]
    bag = revenue.inpatient_revenue(world(**ward(gl_sub_ledgers=same_text)), *WINDOW)
    assert totals(bag, "receivable") == money(200)
    er = revenue.emergency_revenue(world(**at_emergency(ward(gl_sub_ledgers=same_text))), *WINDOW)
    assert totals(er, "receivable") == money(100)
    panel = revenue.panel_inpatient(world(**ward(gl_sub_ledgers=same_text)), AS_OF)
    assert rows_of(panel) == [("Theatre", Decimal("200.00"))]
    two_texts = [sub_ledger("505"), sub_ledger("501", "Wards")]
    er = revenue.emergency_revenue(world(**at_emergency(ward(gl_sub_ledgers=two_texts))), *WINDOW)
    assert len(totals(er, "receivable")) == 2


@pytest.mark.parametrize("hole", [{"client_id": None}, {"department_id": None}])
def test_report_drops_and_panel_keeps_lines_without_client_or_department(world, hole):
    lines = [line(1, **hole)]
    assert (
        revenue.inpatient_revenue(world(**ward(invoice_master_bill_dist=lines)), *WINDOW).count()
        == 0
    )
    er = at_emergency(ward(invoice_master_bill_dist=lines))
    assert revenue.emergency_revenue(world(**er), *WINDOW).count() == 0
    out = as_outpatient(ward(invoice_master_bill_dist=lines))
    assert revenue.outpatient_revenue(world(**out), *WINDOW).count() == 0
    kept = [("Theatre", Decimal("100.00"))]
    assert rows_of(revenue.panel_inpatient(world(**ward(invoice_master_bill_dist=lines)), AS_OF)) == kept
    assert rows_of(revenue.panel_emergency(world(**er), AS_OF)) == kept
    assert rows_of(revenue.panel_outpatient(world(**out), AS_OF)) == kept


def test_unset_filters_drop_unnamed_doctors_and_sub_ledgers(world):
    unnamed = [{"doctor_id": 3, "name": None, "department": "Surgery"}]
    assert revenue.inpatient_revenue(world(**ward(v_doctor=unnamed)), *WINDOW).count() == 0
    assert revenue.panel_inpatient(world(**ward(v_doctor=unnamed)), AS_OF).count() == 1
    blank = [sub_ledger(text=None)]
    assert revenue.inpatient_revenue(world(**ward(gl_sub_ledgers=blank)), *WINDOW).count() == 0
    assert revenue.panel_inpatient(world(**ward(gl_sub_ledgers=blank)), AS_OF).count() == 1


def test_outpatient_without_referring_doctor(world):
    order = [{**ORDER, "patient_type_id": 2, "reffering_inhouse_doctor_id": None}]
    tables = world(**as_outpatient(ward(order_master=order)))
    assert revenue.outpatient_revenue(tables, *WINDOW).count() == 0
    assert revenue.panel_outpatient(tables, AS_OF).count() == 1


def test_outpatient_needs_an_order_with_a_patient_type(world):
    tables = world(**as_outpatient(ward(order_master=[])))
    assert revenue.panel_outpatient(tables, AS_OF).count() == 0


def test_text_filters_ignore_case_and_keep_wildcards(world):
    tables = world(**ward())

    def hits(**filters):
        return revenue.inpatient_revenue(tables, *WINDOW, **filters).count()

    assert hits(name="gRaY") == 1 and hits(name="house") == 0
    assert hits(department="surg", patient_type="PAN", sub_ledger="theat") == 1
    assert hits(name="g_ay") == 1 and hits(name="d%y") == 1
    assert hits(name="\\") == 0 and hits(name="") == 1


def test_a_backslash_in_a_filter_is_a_plain_character(world):
    doctors = [{"doctor_id": 3, "name": "A\\B", "department": "Surgery"}]
    tables = world(**ward(v_doctor=doctors))
    assert revenue.inpatient_revenue(tables, *WINDOW, name="a\\b").count() == 1
    assert revenue.inpatient_revenue(tables, *WINDOW, name="a\\\\b").count() == 0


def test_two_final_invoices_double_the_inpatient_panel_only(world):
    two = [final("2024-01-15"), final("2024-01-20")]
    tables = world(**ward(final_invoice_master=two))
    assert rows_of(revenue.panel_inpatient(tables, AS_OF)) == [("Theatre", Decimal("200.00"))]
    assert totals(revenue.inpatient_revenue(tables, *WINDOW), "receivable") == money(100)
    er = world(**at_emergency(ward(final_invoice_master=two)))
    assert rows_of(revenue.panel_emergency(er, AS_OF)) == [("Theatre", Decimal("100.00"))]


def test_emergency_label_is_caseless_in_reports_and_exact_in_panels(world):
    lower = world(**at_emergency(ward(), place=3))
    assert revenue.emergency_revenue(lower, *WINDOW).count() == 1
    assert revenue.inpatient_revenue(lower, *WINDOW).count() == 0
    assert revenue.panel_emergency(lower, AS_OF).count() == 0
    assert revenue.panel_inpatient(lower, AS_OF).count() == 1


def test_a_location_without_description_is_in_neither_setting(world):
    nowhere = [{"location_id": 101, "order_location_id": 1, "description": None}]
    tables = world(**ward(order_location=nowhere))
    assert revenue.inpatient_revenue(tables, *WINDOW).count() == 0
    assert revenue.emergency_revenue(tables, *WINDOW).count() == 0
    assert revenue.panel_inpatient(tables, AS_OF).count() == 0
    assert revenue.panel_emergency(tables, AS_OF).count() == 0


def test_rolling_window_has_a_time_of_day_and_no_end(world):
    def seen(when, as_of):
        tables = world(**ward(final_invoice_master=[final(when)]))
        return revenue.panel_inpatient(tables, as_of).count()

    from datetime import datetime

    noon = datetime(2024, 1, 31, 12)
    assert seen("2024-01-01T12:00", noon) == 1
    assert seen("2024-01-01T11:59", noon) == 0
    assert seen("2031-01-01", noon) == 1


def test_dashboard_is_the_three_panels(world):
    tables = ward()
    tables["invoice_master"] += [
        {**tables["invoice_master"][0], "invoice_no": 2, "admission_no": None},
        {**tables["invoice_master"][0], "invoice_no": 3, "order_location_id": 2},
    ]
    tables["invoice_master_bill_dist"] += [line(2, 7), line(3, 30)]
    built = world(**tables)
    assert rows_of(revenue.revenue_dashboard(built, AS_OF)) == [
        ("ear_revenue", "Theatre", Decimal("30.00")),
        ("ipd_revenue", "Theatre", Decimal("100.00")),
        ("opd_revenue", "Theatre", Decimal("7.00")),
    ]


def test_a_head_of_unknown_amounts_stays_unknown(world):
    tables = world(**ward(invoice_master_bill_dist=[line(1, None)]))
    assert rows_of(revenue.panel_inpatient(tables, AS_OF)) == [("Theatre", None)]


def test_missing_or_malformed_dates_are_refused(world):
    tables = world(**ward())
    with pytest.raises(ValueError, match="start"):
        revenue.inpatient_revenue(tables, None, "2024-02-01")
    with pytest.raises(ValueError, match="end"):
        revenue.inpatient_revenue(tables, "2024-01-01", "02/01/2024")
