"""Exact distinct counts by bits, alone and merged."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from helpers import rows_of
from wardbook.functions.distincts import counted, numbered_partials, united_partials
from wardbook.plans.registry import REPORTS
from wardbook.sources.fixtures import fixture_tables

NUMBERS = [None, 0, 1, 2, 32767, 32768, 32769, 65536, -1, -32768, -32769, 2**40, 2**40 + 1, 2**62, -(2**62)]


@pytest.fixture
def rows(spark):
    rng = random.Random(1)
    data = [
        (rng.choice(["a", "b", None]), rng.randint(1, 3), rng.choice([*NUMBERS, rng.randint(0, 200_000)]), rng.randint(-5, 5))
        for _ in range(3000)
    ]
    data += [("only null", 1, None, 7), ("only null", 2, None, None)]
    return spark.createDataFrame(data, "name string, day int, number bigint, amount bigint")


def expected(rows):
    return rows_of(rows.groupBy("name").agg(F.count_distinct("number").alias("n"), F.sum("amount").alias("amount")))


def test_counts_equal_count_distinct(rows):
    partials = numbered_partials(rows, ["name"], "number", amount=F.col("amount"))
    assert rows_of(counted(partials, ["name"], "n", ["amount"])) == expected(rows)


def test_days_merge_exactly(rows):
    by_day = numbered_partials(rows, ["name", "day"], "number", amount=F.col("amount"))
    united = united_partials(by_day, ["name"], ["amount"])
    assert rows_of(counted(united, ["name"], "n", ["amount"])) == expected(rows)
    two = rows.where("day < 3")
    some = united_partials(by_day.where("day < 3"), ["name"], ["amount"])
    assert rows_of(counted(some, ["name"], "n", ["amount"])) == expected(two)


def test_numbers_are_never_shuffled_as_keys(rows):
    partials = numbered_partials(rows, ["name"], "number", amount=F.col("amount"))
    plan = counted(partials, ["name"], "n", ["amount"])._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(exchanges) == 2 and not any(re.search(r"\bnumber#", keys) for keys in exchanges)
    assert "bitmap_construct_agg" in plan and "number_bits#" in plan


def test_nothing_counts_as_nothing(spark):
    none = spark.createDataFrame([], "name string, number bigint")
    assert counted(numbered_partials(none, ["name"], "number"), ["name"], "n", []).count() == 0


@pytest.mark.parametrize("key", ["inpatient_revenue", "emergency_revenue", "outpatient_revenue"])
def test_revenue_is_the_same_when_counted_by_bits(spark, small_dir, key):
    tables = fixture_tables(spark, small_dir)
    plain = rows_of(REPORTS[key](tables, **entry_module.PARAMETERS[key]))
    tables.count_by_bits = True
    report = REPORTS[key](tables, **entry_module.PARAMETERS[key])
    assert plain and rows_of(report) == plain
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap_construct_agg" in plan and "count(distinct" not in plan
