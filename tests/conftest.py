from __future__ import annotations

import os
import sys
from datetime import datetime
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wardbook.session import tune  # noqa: E402
from wardbook.sources.catalog import Tables, declared_columns  # noqa: E402
from wardbook.sources.schemas import SCHEMAS  # noqa: E402

DATA_ROOT = os.environ.get("TESTDATA_ROOT", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("wardbook tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    return f"{DATA_ROOT}/sf0.001"


def typed(kind: str, value):
    """A Python value of the kind a column wants, from a short spelling."""
    if value is None:
        return None
    if kind.startswith("decimal"):
        return Decimal(str(value))
    if kind == "timestamp_ntz" and isinstance(value, str):
        return datetime.fromisoformat(value)
    return value


def arrow(kind: str) -> pa.DataType:
    """The Arrow type of a column; rows given as Arrow become a local relation in the plan."""
    if kind.startswith("decimal"):
        precision, scale = kind[8:-1].split(",")
        return pa.decimal128(int(precision), int(scale))
    return {
        "int": pa.int32(),
        "bigint": pa.int64(),
        "string": pa.string(),
        "timestamp_ntz": pa.timestamp("us"),
    }[kind]


@pytest.fixture(scope="session")
def made():
    """Hand-written tables already made, by name and content."""
    return {}


@pytest.fixture
def world(spark, made):
    """Build a catalog from hand-written rows: ``world(client=[{...}], ...)``; the rest is empty."""

    def build(empty_as_null: bool = False, **tables) -> Tables:
        def load(name):
            content = (name, repr(tables.get(name, [])))
            if content not in made:
                made[content] = local_table(name)
            return made[content]

        def local_table(name):
            columns = declared_columns(name)
            known = {column for column, _ in columns}
            for row in tables.get(name, []):
                assert set(row) <= known, set(row) - known
            arrays = [
                pa.array([typed(kind, row.get(column)) for row in tables.get(name, [])], arrow(kind))
                for column, kind in columns
            ]
            rows = pa.table(arrays, names=[column for column, _ in columns])
            return spark.createDataFrame(rows, SCHEMAS[name])

        assert set(tables) <= set(SCHEMAS), set(tables) - set(SCHEMAS)
        return Tables(load, empty_as_null=empty_as_null)

    return build
