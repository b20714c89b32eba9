"""Every report against its SQL statement, run by another engine on the same tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_module
from wardbook.plans.registry import REPORTS
from wardbook.sources.fixtures import BASE_TABLES

STATEMENTS = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck(small_dir):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in BASE_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small_dir}/{table}.parquet'")
    yield connection
    connection.close()


def ordered(rows):
    return sorted(tuple(str(value) for value in row) for row in rows)


def test_every_report_has_a_statement():
    assert set(REPORTS) <= set(STATEMENTS) <= set(entry_module.queries())


@pytest.mark.parametrize("key", list(REPORTS))
def test_report_equals_statement(key, spark, small_dir, duck):
    report = entry_module.queries()[key](spark, small_dir)
    result = duck.execute(STATEMENTS[key])
    names = [column[0] for column in result.description]
    assert sorted(names) == sorted(report.columns)
    assert len(set(names)) == len(names)
    expected = result.fetchall()
    assert expected, "the statement must return rows to compare"
    actual = [tuple(row) for row in report.select(*names).collect()]
    assert ordered(actual) == ordered(expected)


def test_entry_returns_the_flagship_report(spark):
    flagship = entry_module.entry(spark)
    assert flagship.columns[:2] == ["adm_doctor", "adm_department"]
    assert flagship.count() > 0
