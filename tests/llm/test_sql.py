"""Queries against their SQL, on the tables they are registered for."""

from __future__ import annotations

import duckdb
import pytest

from wardbook.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, small_dir, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings"):
        connection.execute(f"create view {table} as select * from '{small_dir}/{table}.parquet'")
    wanted = connection.execute(ORACLE_SQL[name])
    columns = [c[0] for c in wanted.description]
    found = QUERIES[name](spark, small_dir)
    assert sorted(columns) == sorted(found.columns)
    assert sorted(tuple(r) for r in found.select(columns).collect()) == sorted(wanted.fetchall())
