"""Catalogs over files, tables and a database, and the report files."""

from __future__ import annotations

import csv
import json
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers import rows_of
from wardbook.plans.registry import REPORTS
from wardbook.sinks.reports import SHEET_DATE_COLUMNS, sheet, write_rows, write_sheet, write_table
from wardbook.sources.catalog import Tables, declared_columns, number_ranges
from wardbook.sources.fixtures import FIXTURES, fixture_tables
from wardbook.sources.schemas import FACTS, OWNERS, SCHEMAS


def test_every_fixture_is_declared_filled_and_of_its_declared_type(spark, small_dir):
    tables = fixture_tables(spark, small_dir)
    assert set(FIXTURES) == set(SCHEMAS) == set(OWNERS) and len(SCHEMAS) == 56
    for name in SCHEMAS:
        assert [(f.name, f.dataType.simpleString()) for f in tables[name].schema] == (
            declared_columns(name)
        )
        assert not tables[name].isEmpty(), name


def test_unknown_tables_are_refused(world):
    tables = world()
    with pytest.raises(KeyError, match="nothing"):
        tables["nothing"]
    with pytest.raises(AttributeError, match="nothing"):
        _ = tables.nothing


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
def test_files_of_every_format_give_the_same_report(spark, world, tmp_path, fmt):
    users = [{"mrno": 7, "full_name": "U", "userid": 1, "terminal": "T"}] * 2
    world(users=users).users.write.format(fmt).save(str(tmp_path / "users"))
    report = REPORTS["user_account_counts"](Tables.from_files(spark, str(tmp_path), fmt))
    assert rows_of(report) == [(7, "U", 2)]


def test_metastore_tables(spark, world, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS ward_books LOCATION '{tmp_path}'")
    try:
        rows = world(users=[{"mrno": 7, "full_name": "U"}]).users
        rows.write.mode("overwrite").saveAsTable("ward_books.users")
        tables = Tables.from_catalog(spark, "ward_books")
        assert rows_of(tables.users, "mrno") == [(7,)]
    finally:
        spark.sql("DROP DATABASE ward_books CASCADE")


class Reader:
    """Stands for ``spark.read`` and keeps what it is told."""

    def __init__(self, frame):
        self.frame, self.said = frame, {}

    @property
    def read(self):
        return self

    def format(self, name):
        self.said["format"] = name
        return self

    def option(self, key, value):
        self.said[key] = value
        return self

    def options(self, **pairs):
        self.said.update(pairs)
        return self

    def load(self):
        return self.frame


def test_database_tables_are_read_in_parallel_ranges(spark, world):
    reader = Reader(world(users=[{"mrno": 7}]).users)
    split = {"partitionColumn": "mrno", "lowerBound": "0", "upperBound": "9", "numPartitions": "4"}
    tables = Tables.from_jdbc(
        reader, "jdbc:oracle:thin:@//host/service", {"user": "u"}, splits={"users": split}
    )
    assert rows_of(tables.users, "mrno") == [(7,)]
    assert reader.said == {
        "format": "jdbc",
        "url": "jdbc:oracle:thin:@//host/service",
        "dbtable": "security.users",
        "preferTimestampNTZ": "true",
        "customSchema": SCHEMAS["users"],
        "fetchsize": "10000",
        "user": "u",
        **split,
    }


@pytest.mark.parametrize("parts", [1, 2, 3, 7, 50])
@pytest.mark.parametrize(("low", "high"), [(0, 0), (1, 10), (-7, 6), (5, 104), (-(2**40), 2**40), (None, None)])
def test_number_ranges_share_every_row_once(spark, low, high, parts):
    conditions = number_ranges("k", low, high, parts)
    assert len(conditions) <= parts + 2
    around = [None, low, high, *(v + d for v in (low or 0, high or 0) for d in (-1, 1)), 0, 3, 10**15]
    rows = spark.createDataFrame([(v,) for v in {*around, *range(-9, 110)}], "k bigint")
    met = sum(F.coalesce(F.expr(c), F.lit(False)).cast("int") for c in conditions)
    assert [row[0] for row in rows.select(met.alias("met")).distinct().collect()] == [1]


class SharedReader(Reader):
    """Answers the query for bounds with one row, and the shares with the table."""

    def __init__(self, bounds, frame):
        super().__init__(bounds)
        self.rows = frame

    def jdbc(self, url, table, predicates, properties):
        self.asked = {"url": url, "table": table, "predicates": predicates, "properties": properties}
        return self.rows


@pytest.mark.parametrize(
    ("bounds", "conditions"),
    [
        ("decimal(38,0) '1' as low, decimal(38,0) '10' as high", ["mrno < 6", "mrno >= 6", "mrno IS NULL"]),
        ("cast(null as int) as low, cast(null as int) as high", ["mrno IS NOT NULL", "mrno IS NULL"]),
    ],
)
def test_database_tables_find_their_own_bounds(spark, world, bounds, conditions):
    text = bounds.replace("decimal(38,0) '", "cast('").replace("' as", "' as decimal(38,0)) as")
    reader = SharedReader(spark.sql(f"select {text}"), world(users=[{"mrno": 7}]).users)
    tables = Tables.from_jdbc(reader, "jdbc:x", {"user": "u"}, shares={"users": ("mrno", 2)})
    assert rows_of(tables.users, "mrno") == [(7,)]
    assert reader.said["dbtable"] == "(SELECT MIN(mrno) AS low, MAX(mrno) AS high FROM security.users) bounds"
    assert reader.said["user"] == "u" and "customSchema" not in reader.said
    assert reader.asked == {
        "url": "jdbc:x",
        "table": "security.users",
        "predicates": conditions,
        "properties": {"user": "u", "customSchema": SCHEMAS["users"], "preferTimestampNTZ": "true", "fetchsize": "10000"},
    }


def test_facts_are_not_read_through_one_connection(world):
    tables = Tables.from_jdbc(Reader(world().inventory_ledger), "u", {})
    with pytest.raises(ValueError, match="inventory_ledger"):
        tables.inventory_ledger  # noqa: B018
    assert FACTS <= set(SCHEMAS)


def test_database_relation_can_be_replaced(spark, world):
    reader = Reader(world(item_label=[{"item_id": 1, "label": "L"}]).item_label)
    labels = "(select item_id, label_of(item_id) label from items) t"
    tables = Tables.from_jdbc(reader, "u", {}, relations={"item_label": labels})
    assert rows_of(tables.item_label) == [(1, "L")]
    assert reader.said["dbtable"] == labels


def read_parts(folder, suffix):
    """Part files in name order, which is the order of the report."""
    return [path.read_text() for path in sorted(Path(folder).glob(f"part-*{suffix}"))]


def test_sheet_shows_dates_and_keeps_the_order(spark, tmp_path):
    rows = spark.sql(
        "select * from values (timestamp_ntz '2024-03-05 10:00:00', 2, 1.50),"
        " (timestamp_ntz '2024-01-31 00:00:00', 1, null) as r(receive_date, receive_no, amount)"
    ).orderBy("receive_no")
    write_sheet("client_receipts", rows, str(tmp_path / "sheet"))
    lines = [
        line
        for text in read_parts(tmp_path / "sheet", ".csv")
        for line in csv.reader(text.splitlines())
        if line[0] != "receive_date"
    ]
    assert lines == [["31-Jan-2024", "1", ""], ["05-Mar-2024", "2", "1.50"]]


def test_text_sheet_blanks_nulls(spark, tmp_path):
    rows = spark.sql(
        "select timestamp_ntz '2024-03-05 10:00:00' as joining_date, cast(null as string) as nic, 7 as mrno"
    )
    shown = sheet("allowance_deductions", rows)
    assert rows_of(shown) == [("05-Mar-2024", "", "7")]
    write_sheet("allowance_deductions", rows, str(tmp_path / "sheet"))
    assert read_parts(tmp_path / "sheet", ".csv")[0].splitlines()[1] == "05-Mar-2024,,7"


def test_rows_keep_null_fields(spark, tmp_path):
    write_rows(spark.sql("select 1 as a, cast(null as int) as b"), str(tmp_path / "rows"))
    assert [json.loads(text) for text in read_parts(tmp_path / "rows", ".json")] == [
        {"a": 1, "b": None}
    ]


def test_table_keeps_types(spark, tmp_path):
    frame = spark.sql("select timestamp_ntz '2024-03-05 10:00:00' as at, cast(1.5 as decimal(28,2)) as d")
    write_table(frame, str(tmp_path / "table"))
    back = spark.read.parquet(str(tmp_path / "table"))
    assert back.dtypes == frame.dtypes
    assert rows_of(back) == [(datetime(2024, 3, 5, 10), Decimal("1.50"))]


def test_sheet_dates_are_columns_of_their_report(spark, small_dir):
    import __spark_entry__ as entry_module

    for key, dates in SHEET_DATE_COLUMNS.items():
        columns = dict(entry_module.queries()[key](spark, small_dir).dtypes)
        assert all(columns[name] == "timestamp_ntz" for name in dates), key
