"""Stand-in source tables derived from the TPC-H-like test tables.

One projection per source table, in SQL that Spark and DuckDB both accept.
``{orders}`` and the like are filled with a DataFrame on the Spark side and
with the view name on the DuckDB side.  Every projection reads whole tables.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from wardbook.sources.catalog import Tables

BASE_TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
)

FIXTURES: dict[str, str] = {
    "invoice_master": """
        select o_orderkey as invoice_no, o_orderdate as invoice_date, o_custkey as mrno, case when
        o_orderkey%3=0 then null else o_orderkey end as admission_no, 101 as location_id, o_orderkey%5 as
        order_location_id, o_orderkey%2 as order_type_id, o_orderkey as order_no from {orders}
    """,
    "invoice_master_bill_dist": """
        select l_orderkey as invoice_no, l_linenumber as serial_no, l_suppkey as contract_id, l_partkey as
        item_id, cast(l_quantity as decimal(18,2)) as qty, cast(l_extendedprice as decimal(18,2)) as amount,
        case when l_suppkey%7=0 then null else cast(l_suppkey as string) end as client_id, l_partkey%5 as
        income_id, case when l_partkey%9=0 then null else l_partkey%25 end as department_id from {lineitem}
    """,
    "return_master": """
        select o_orderkey as return_no, o_orderkey as invoice_no, o_orderdate + interval '10' day as
        return_date, o_custkey as mrno, case when o_orderkey%3=0 then null else o_orderkey end as
        admission_no, 101 as location_id, o_orderkey%5 as order_location_id, o_orderkey%2 as order_type_id,
        o_orderkey as order_no from {orders}
    """,
    "return_master_bill_dist": """
        select l_orderkey as return_no, l_linenumber as serial_no, l_suppkey as contract_id, l_partkey as
        item_id, cast(l_quantity as decimal(18,2)) as qty, cast(l_extendedprice as decimal(18,2)) as amount,
        case when l_suppkey%7=0 then null else cast(l_suppkey as string) end as client_id, l_partkey%5 as
        income_id, case when l_partkey%9=0 then null else l_partkey%25 end as department_id from {lineitem}
        where l_returnflag='R'
    """,
    "order_patient_admission": """
        select o_custkey as mrno, o_orderkey as admission_no, o_orderkey%10 as doctor_id, o_orderkey%2 as
        order_type_id, o_orderkey as order_no, 101 as location_id, o_orderkey%5 as order_location_id,
        o_orderdate as admission_final_time, o_orderdate + interval '5' day as discharge_date, o_orderstatus
        as order_admission_type from {orders}
    """,
    "order_master": """
        select o_orderkey%2 as order_type_id, o_orderkey as order_no, 101 as location_id, o_orderkey%5 as
        order_location_id, cast(substr(o_orderpriority,1,1) as int) as patient_type_id, case when
        o_orderkey%11=0 then null else o_orderkey%10 end as reffering_inhouse_doctor_id from {orders}
    """,
    "patient_type": """
        select distinct cast(substr(o_orderpriority,1,1) as int) as patient_type_id,
        substr(o_orderpriority,3) as description from {orders}
    """,
    "v_doctor": """
        select s_suppkey as doctor_id, s_name as name, n_name as department from {supplier} join {nation} on
        s_nationkey=n_nationkey
    """,
    "client": """
        select cast(s_suppkey as string) as client_id, case s_suppkey%20 when 0 then concat(s_name,' Fund')
        when 1 then concat(s_name,' Nephro') else s_name end as name from {supplier} union all select
        '1012000041','Social Security Payer'
    """,
    "order_location": """
        select 101 as location_id, r_regionkey as order_location_id, case when r_regionkey=4 then
        'ADULT/PAEDS-EMERGENCY - FMH' else r_name end as description from {region}
    """,
    "income_setup": """
        select r_regionkey as income_id, r_name as income_description from {region}
    """,
    "v_patient": """
        select c_custkey as mrno, c_name as name, concat('NIC-', cast(c_custkey as string)) as nic_new from
        {customer}
    """,
    "gl_sub_ledgers": """
        select n_nationkey as sub_ldgr_item_code, n_name as sub_ldgr_item_desc, '505' as ledger_type_code,
        '101' as location_id from {nation} union all select n_nationkey, n_name, '501', '101' from {nation}
        where n_nationkey<5
    """,
    "final_invoice_master": """
        select o_orderkey as final_invoice_no, case o_orderkey%5 when 1 then o_orderkey else
        o_orderkey-o_orderkey%5 end as client_invoice_no, case when o_orderkey%13=0 then null else
        cast(o_custkey%100 as string) end as client_id, o_custkey as mrno, o_orderkey%10 as process_id,
        o_orderdate + interval '20' day as final_invoice_date, case o_orderkey%5 when 0 then 'R' when 1 then
        'H' when 2 then 'I' when 3 then 'O' else 'X' end as final_invoice_type, cast(o_totalprice as
        decimal(18,2)) as net_receivable, case o_orderkey%4 when 0 then null when 1 then cast(o_totalprice
        as decimal(18,2)) when 2 then cast(o_totalprice as decimal(18,2))-cast(o_orderkey%1000 as
        decimal(18,2)) else cast(0 as decimal(18,2)) end as received_amount, case when o_orderkey%3=0 then
        null else o_orderkey end as admission_no, o_orderdate as admission_date from {orders}
    """,
    "pbs_tran_detail_corporate": """
        select o_orderkey%10 as process_id, case when o_orderkey%13=0 then null else cast(o_custkey%100 as
        string) end as client_id, case o_orderkey%5 when 1 then o_orderkey else o_orderkey-o_orderkey%5 end
        as final_invoice_no, o_custkey as mrno, case when o_orderkey%3=0 then null else o_orderkey end as
        admission_no, case when o_orderkey%4=0 then null else o_orderkey-o_orderkey%4 end as ref_letter_no
        from {orders} where o_orderpriority<>'4-NOT SPECIFIED'
    """,
    "ref_letter_master": """
        select o_orderkey as ref_letter_no, concat('REF', cast(o_orderkey as string)) as client_ref_no,
        o_orderdate as trans_date, o_custkey as mrno from {orders}
    """,
    "pbs_tran_detail": """
        select case when l_orderkey%3=0 then '1012000041' else cast(l_suppkey as string) end as client_id,
        case when l_linenumber%2=0 then '911010' else '911011' end as coa_code, l_partkey as mrno,
        l_orderkey as trans_no, l_orderkey as admission_no, case when l_partkey%3=0 then null else
        l_orderkey-l_orderkey%4 end as ref_letter_no, cast(l_extendedprice as decimal(18,2)) as dr_amount,
        case when l_partkey%17=0 then null else cast(l_quantity as decimal(18,2)) end as cr_amount from
        {lineitem}
    """,
    "cash_receive_master": """
        select o_orderkey as receive_no, case when o_orderkey%6=0 then null else cast(o_custkey%100 as
        string) end as client_id, o_custkey as received_by, o_orderdate + interval '9' hour as receive_date,
        cast(o_totalprice as decimal(18,2)) as total_amount, o_orderpriority as remarks, o_orderkey as
        sale_id, o_orderkey as invoice_no from {orders}
    """,
    "cash_receive_detail": """
        select l_orderkey as receive_no, case (l_linenumber)%3 when 0 then '001006' when 1 then '001001'
        else '001002' end as payment_mode_id, l_linenumber as instrument_no, cast(l_extendedprice as
        decimal(18,2)) as amount, case when l_discount<0.02 then null else cast(l_quantity as decimal(18,2))
        end as wht_tax, case l_partkey%3 when 0 then null when 1 then cast(l_extendedprice as decimal(18,2))
        else cast(l_extendedprice as decimal(18,2))-40 end as received_amount, l_orderkey as
        final_invoice_no, l_suppkey as merchant_id, l_shipdate as validity_date from {lineitem}
    """,
    "cash_refund_master": """
        select o_orderkey as receipt_no, case when o_orderkey%40=0 then null else cast(o_custkey%100 as
        string) end as client_id from {orders} where o_orderpriority='5-LOW' and o_orderstatus='P'
    """,
    "payment_mode": """
        select '001006' as payment_mode_id, 'CREDIT CARD' as description union all select '001001','CASH'
        union all select '001002','CHEQUE'
    """,
    "payment_mode_wise_merchant": """
        select s_suppkey as merchant_id, s_name as description from {supplier}
    """,
    "franchise_cheque": """
        select o_orderkey as final_receipt_no, o_orderkey as receive_no from {orders}
    """,
    "final_receipt_detail2": """
        select l_orderkey as final_receipt_no, l_partkey as mrno, cast(l_extendedprice as decimal(18,2)) as
        invoice_amount, case when l_partkey%4=0 then null else cast(l_quantity as decimal(18,2)) end as
        received_amount, cast(l_quantity as decimal(18,2)) as adjusted_amount, cast(l_quantity as
        decimal(18,2))+1 as adjust_amount, l_orderkey as client_invoice_no, case when l_returnflag='R' then
        'Y' else 'N' end as chk_option from {lineitem}
    """,
    "vu_information": """
        select c_custkey as mrno, c_name as name, c_mktsegment as department, concat('Grade ',
        cast(c_nationkey%4 as string)) as designation, case when c_custkey%10=0 then null else
        cast(make_date(2000+c_nationkey%20, 1+c_nationkey%12, 1) as timestamp) end as joining_date,
        concat('NIC-', cast(c_custkey as string)) as nic from {customer}
    """,
    "v_information": """
        select c_custkey as mrno, c_name as name, c_mktsegment as department, concat('Grade ',
        cast(c_nationkey%4 as string)) as designation, case when c_custkey%10=0 then null else
        cast(make_date(2000+c_nationkey%20, 1+c_nationkey%12, 1) as timestamp) end as joining_date,
        concat('NIC-', cast(c_custkey as string)) as nic from {customer}
    """,
    "gl_coa": """
        select concat(cast(1+p_partkey%9 as string), lpad(cast(p_partkey as string),8,'0')) as coa_code,
        p_name as coa_description, cast(p_partkey%5 as string) as coa_level_code, case p_partkey%3 when 0
        then '505' when 1 then '501' else '502' end as ledger_type_code from {part} union all select
        '1113116004','Corporate receivable','4','505'
    """,
    "gl_tran_master": """
        select case o_orderkey%3 when 0 then 'JV' when 1 then 'CP' else 'BR' end as voucher_type, o_orderkey
        as voucher_no, o_orderdate as trans_date, concat('CHQ', cast(o_orderkey as string)) as reference_no,
        o_orderpriority as remarks, case o_orderstatus when 'P' then 'P' when 'F' then 'T' else 'U' end as
        voucher_status from {orders}
    """,
    "gl_tran_detail": """
        select case l_orderkey%3 when 0 then 'JV' when 1 then 'CP' else 'BR' end as voucher_type, l_orderkey
        as voucher_no, l_shipdate as trans_date, case when l_partkey%10=0 then '1113116004' else
        concat(cast(1+l_partkey%9 as string), lpad(cast(l_partkey as string),8,'0')) end as coa_code, case
        when l_partkey%2=0 then '505' else '501' end as ledger_type_code, l_suppkey%30 as
        sub_ldgr_item_code, l_linestatus as narration, case when l_linenumber%2=0 then cast(l_extendedprice
        as decimal(18,2)) else cast(0 as decimal(18,2)) end as dr_amount, case when l_linenumber%2=1 then
        cast(l_extendedprice as decimal(18,2)) else cast(0 as decimal(18,2)) end as cr_amount from
        {lineitem}
    """,
    "pf_tran_master": """
        select case o_orderkey%3 when 0 then 'JV' when 1 then 'CP' else 'BR' end as voucher_type, o_orderkey
        as voucher_no, o_orderdate as trans_date, concat('CHQ', cast(o_orderkey as string)) as reference_no,
        o_orderpriority as remarks, case o_orderstatus when 'P' then 'P' when 'F' then 'T' else 'U' end as
        voucher_status from {orders}
    """,
    "pf_tran_detail": """
        select case l_orderkey%3 when 0 then 'JV' when 1 then 'CP' else 'BR' end as voucher_type, l_orderkey
        as voucher_no, l_shipdate as trans_date, concat(cast(1+l_partkey%9 as string), lpad(cast(l_partkey
        as string),8,'0')) as coa_code, case when l_partkey%2=0 then '505' else '501' end as
        ledger_type_code, l_suppkey%30 as sub_ldgr_item_code, l_linestatus as narration, case when
        l_linenumber%2=0 then cast(l_extendedprice as decimal(18,2)) else cast(0 as decimal(18,2)) end as
        dr_amount, case when l_linenumber%2=1 then cast(l_extendedprice as decimal(18,2)) else cast(0 as
        decimal(18,2)) end as cr_amount from {lineitem}
    """,
    "gl_financial_year": """
        select concat(cast(1995+r_regionkey as string),'-',cast(1996+r_regionkey as string)) as year_code,
        cast(make_date(1995+r_regionkey,7,1) as timestamp) as from_date,
        cast(make_date(1996+r_regionkey,6,30) as timestamp) as to_date from {region}
    """,
    "gl_opening_balances": """
        select concat(cast(y as string),'-',cast(y+1 as string)) as year_code, coa_code, ledger_type_code,
        sub_ldgr_item_code, cast(sub_ldgr_item_code*100 as decimal(18,2)) as open_dr, cast((y-1995)*10 as
        decimal(18,2)) as open_cr, cast(sub_ldgr_item_code+5 as decimal(18,2)) as tran_dr, case when
        sub_ldgr_item_code%6=0 then null else cast(y-1995 as decimal(18,2)) end as tran_cr from (select
        distinct year(l_shipdate) - case when month(l_shipdate)<7 then 1 else 0 end as y, case when
        l_partkey%10=0 then '1113116004' else concat(cast(1+l_partkey%9 as string), lpad(cast(l_partkey as
        string),8,'0')) end as coa_code, case when l_partkey%2=0 then '505' else '501' end as
        ledger_type_code, cast(l_suppkey%30 as int) as sub_ldgr_item_code from {lineitem}) seen
    """,
    "gl_trial_sub_ledgers": """
        select concat(cast(1+l_partkey%9 as string), lpad(cast(l_partkey as string),8,'0')) as coa_code,
        l_returnflag as coa_description, '505' as ledger_type_code, l_partkey%25 as sub_ldgr_item_code,
        l_linestatus as sub_ledger_item_desc, cast(0 as decimal(18,2)) as year_open_dr, cast(0 as
        decimal(18,2)) as year_open_cr, cast(l_partkey%2 as decimal(18,2)) as run_open_dr, cast(0 as
        decimal(18,2)) as run_open_cr, cast(l_partkey%3 as decimal(18,2)) as tran_dr, cast(l_partkey%5 as
        decimal(18,2)) as tran_cr, cast(l_quantity as decimal(18,2)) as close_dr, cast(0 as decimal(18,2))
        as close_cr, l_suppkey%10 as user_id, concat('T',cast(l_suppkey%3 as string)) as terminal from
        {lineitem}
    """,
    "users": """
        select c_custkey as mrno, c_name as full_name, c_custkey%10 as userid, concat('T',cast(c_custkey%3
        as string)) as terminal from {customer}
    """,
    "mms_item_ledger": """
        select l_shipdate as trans_date, concat('1011', cast(l_suppkey%25 as string)) as store_id, l_partkey
        as item_id, l_partkey%25 as cost_centre_id, case l_linenumber%3 when 0 then '16' when 1 then '2'
        else '9' end as move_type_id, case when l_partkey%6=0 then null else cast(l_quantity as
        decimal(18,2)) end as qty_cr, case when l_partkey%4=0 then null else cast(1 as decimal(18,2)) end as
        qty_dr, cast(l_extendedprice as decimal(18,4)) as unit_cost from {lineitem}
    """,
    "def_move_type": """
        select '16' as move_type_id union all select '2' union all select '9'
    """,
    "store": """
        select concat('1011', cast(n_nationkey as string)) as store_id, case n_nationkey when 1 then 'Main
        Pharmacy' when 2 then 'FMH In House Pharmacy' else concat('Store ',n_name) end as description, case
        when n_nationkey%3=0 then 'S' else 'M' end as main_sub from {nation}
    """,
    "item": """
        select p_partkey as item_id, p_name as description from {part}
    """,
    "item_label": """
        select p_partkey as item_id, concat(p_brand,' ',p_name) as label from {part} where p_size<>1
    """,
    "drug_label": """
        select p_partkey as item_id, concat(p_name,' / ',p_brand) as label from {part} where p_size<>2
    """,
    "transaction_type": """
        select '026' as transaction_type_id, 'TRANSFER' as description union all select '001','PURCHASE'
        union all select '002','ISSUE'
    """,
    "inventory_ledger": """
        select concat('1011', cast(l_suppkey%25 as string)) as store_id, l_shipdate + interval '7' hour as
        transaction_date, l_partkey as item_id, case l_linenumber%3 when 0 then '026' when 1 then '001' else
        '002' end as transaction_type_id, case when l_linenumber%3=1 then cast(l_quantity as decimal(18,2))
        end as qty_debit, case when l_linenumber%3<>1 then cast(l_quantity as decimal(18,2)) end as
        qty_credit, cast(l_extendedprice as decimal(18,4)) as moving_average_price from {lineitem}
    """,
    "store_transfer_master": """
        select o_orderkey as trans_no, o_orderdate as approved_date, concat('1011', cast(o_orderkey%25 as
        string)) as from_store_id, concat('1011', cast(o_custkey%25 as string)) as to_store_id, o_custkey as
        delivered_by from {orders}
    """,
    "store_transfer_detail": """
        select l_orderkey as trans_no, l_partkey as item_id, cast(l_quantity as decimal(18,2)) as
        transfered_qty, cast(l_extendedprice as decimal(18,4)) as moving_average_cost, case when
        l_partkey%5=0 then null else cast(1 as decimal(18,2)) end as cancel_qty, case when l_linenumber%2=0
        then '026' else '001' end as transaction_type_id from {lineitem}
    """,
    "donation": """
        select o_orderkey as receipt_no, case when o_orderkey%2=0 then '101' else '102' end as
        receipt_location_id, case when o_orderkey%3=0 then o_orderdate + interval '8' hour else o_orderdate
        end as trans_date, case when o_orderkey%4=0 then null when o_orderkey%7=0 then concat('0',
        lpad(cast(o_custkey as string),8,'0')) else concat(cast(1+o_custkey%9 as string),
        lpad(cast(o_custkey as string),8,'0')) end as coa_code_cr, case when o_orderkey%3=0 then null else
        concat('Other ',cast(o_orderkey as string)) end as name_for_other, concat('Donor ',cast(o_custkey as
        string)) as donor_name, case when o_orderkey%5=0 then null else 'Other street' end as
        address_for_other, 'Donor street' as donor_address, o_custkey as donor_id, o_orderkey%5 as
        donation_type_id, o_orderkey%2 as donation_group_id, case (o_orderkey)%3 when 0 then '001006' when 1
        then '001001' else '001002' end as mode_id, cast(o_orderkey as string) as cheque_no,
        cast(o_totalprice as decimal(18,2)) as amount, o_orderpriority as remarks, o_orderstatus as
        received_by from {orders}
    """,
    "donor": """
        select c_custkey as donor_id, concat('0300', cast(c_custkey as string)) as mobile from {customer}
    """,
    "donation_types": """
        select r_regionkey as donation_type_id, g as donation_group_id, concat(r_name,' ',cast(g as string))
        as description from (select r_regionkey, r_name, 0 as g from {region} union all select r_regionkey, r_name, 1 from {region}) x
    """,
    "def_arrear": """
        select cast(r_regionkey as string) as arrear_code, r_name as description from {region}
    """,
    "pay_arrear": """
        select case when o_orderkey%9=0 then null else '101' end as location_id, o_custkey as mrno,
        cast(o_orderkey%5 as string) as arrear_code, o_orderdate as end_date, case when o_orderkey%8=0 then
        cast(0 as decimal(18,2)) else cast(o_totalprice as decimal(18,2)) end as amount from {orders}
    """,
    "def_allowance_deduction": """
        select lpad(cast(r_regionkey as string),3,'0') as ad_code, r_name as description from {region}
    """,
    "pay_allowance_deduction": """
        select '101' as location_id, o_custkey as mrno, lpad(cast(l_partkey%5 as string),3,'0') as ad_code,
        o_orderdate as end_date, cast(l_quantity as decimal(18,2)) as calc_amount from {lineitem} join
        {orders} on l_orderkey=o_orderkey
    """,
    "def_loan_type": """
        select cast(r_regionkey as string) as loan_code, case when r_regionkey<4 then '101' else '102' end
        as location_id, r_name as description from {region}
    """,
    "loan_payment_master": """
        select o_orderkey as loan_no, cast(o_orderkey%5 as string) as loan_code, cast(o_custkey%5 as string)
        as loan_location_id, o_custkey as mrno from {orders}
    """,
    "loan_refund_detail": """
        select l_orderkey as loan_no, l_shipdate as end_date, l_partkey as mrno, cast(l_extendedprice as
        decimal(18,2)) as loan_amount, cast(l_quantity as decimal(18,2)) as refund_amount from {lineitem}
    """,
    "location": """
        select cast(r_regionkey as string) as location_id, r_name as description from {region}
    """,
}


def one_line(sql: str) -> str:
    """Undo the line wrapping, which may fall inside a quoted text."""
    return " ".join(sql.split())


def base_tables_of(sql: str) -> list[str]:
    """Names of the test tables a fixture projection reads."""
    return sorted({field for _, field, _, _ in string.Formatter().parse(sql) if field})


def fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Catalog whose source tables are projections over ``sf_dir``."""
    base: dict[str, DataFrame] = {}

    def read(name: str) -> DataFrame:
        if name not in base:
            base[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return base[name]

    def load(name: str) -> DataFrame:
        sql = one_line(FIXTURES[name])
        return spark.sql(sql, **{table: read(table) for table in base_tables_of(sql)})

    return Tables(load, FIXTURES)


def fixture_ctes(names: list[str]) -> str:
    """The same projections as a ``WITH`` list for an SQL engine that has the test tables as views."""
    views = {table: table for table in BASE_TABLES}
    return ",\n".join(
        f"{name} AS ({one_line(FIXTURES[name]).format(**views)})" for name in names
    )
