"""NULL rules, windows and lookups on hand-written rows."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from helpers import rows_of, settings
from wardbook.functions.joins import join_reduced
from wardbook.functions.columns import in_order, look_up
from wardbook.functions.moments import (
    from_through,
    from_until,
    last_days,
    parse_moment,
    start_of_day,
)
from wardbook.functions.predicates import matches_if_given, not_in


@pytest.mark.parametrize("listed", ["", "(2)", "(2),(2)", "(2),(null)", "(cast(null as int))", "(9)"])
def test_not_in_equals_sql(spark, listed):
    keys = spark.sql("select * from values (1),(2),(2),(3),(null) as k(key)")
    listing = spark.sql(
        f"select * from values {listed} as l(item)" if listed else "select 1 as item where false"
    )
    expected = spark.sql(
        "select key from {keys} where key not in (select item from {listing})",
        keys=keys,
        listing=listing,
    )
    assert rows_of(not_in(keys, "key", listing)) == rows_of(expected)


def test_not_in_broadcasts_nothing_by_force(spark):
    keys, listing = spark.range(100), spark.range(50).withColumnRenamed("id", "item")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = not_in(keys, "id", listing)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "LeftAnti" in plan and "Broadcast" not in plan


MOMENTS = [
    "2024-01-31 00:00:00",
    "2024-01-31 00:01:00",
    "2024-02-01 00:00:00",
    "2024-01-01 00:00:00",
]


def moments(spark):
    values = ",".join(f"(timestamp_ntz '{text}')" for text in MOMENTS)
    return spark.sql(f"select * from values {values}, (cast(null as timestamp_ntz)) as m(at)")


def seen(frame):
    return sorted(row.at.isoformat(" ") for row in frame.collect())


def test_half_open_window_leaves_the_end_out(spark):
    kept = moments(spark).where(from_until(F.col("at"), "2024-01-01", date(2024, 1, 31)))
    assert seen(kept) == ["2024-01-01 00:00:00"]


def test_closed_window_ends_at_midnight(spark):
    kept = moments(spark).where(from_through(F.col("at"), "2024-01-01", "2024-01-31"))
    assert seen(kept) == ["2024-01-01 00:00:00", "2024-01-31 00:00:00"]


def test_rolling_window_defaults_to_the_clock(spark):
    now = spark.sql("select localtimestamp() as at, 1 as n").unionByName(
        spark.sql("select localtimestamp() - interval 31 days as at, 2 as n")
    )
    assert [row.n for row in now.where(last_days(F.col("at"), None)).collect()] == [1]


def test_start_of_day_does_not_depend_on_the_time_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        day = spark.sql("select timestamp_ntz '2018-11-04 09:00:00' as at")
        assert day.select(start_of_day(F.col("at"))).first()[0] == datetime(2018, 11, 4)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_dates_are_parsed_once_and_strictly():
    assert parse_moment("2024-02-29", "start") == datetime(2024, 2, 29)
    assert parse_moment(datetime(2024, 1, 1, 5), "start") == datetime(2024, 1, 1, 5)
    for bad in ("2023-02-29", "2024/01/01", "", None):
        with pytest.raises(ValueError, match="start"):
            parse_moment(bad, "start")


def test_unset_text_filter_still_drops_null(spark):
    names = spark.sql("select * from values ('Ann'),(null),('50%') as n(name)")
    assert rows_of(names.where(matches_if_given(F.col("name"), None))) == [("50%",), ("Ann",)]
    assert rows_of(names.where(matches_if_given(F.col("name"), "N"))) == [("Ann",)]
    assert rows_of(names.where(matches_if_given(F.col("name"), "0%"))) == [("50%",)]


def test_order_puts_nulls_last_and_breaks_ties(spark):
    rows = spark.sql("select * from values (null,1),(2,5),(2,4),(1,9) as r(a,b)")
    ordered = [tuple(row) for row in in_order(rows, "a").collect()]
    assert ordered == [(1, 9), (2, 4), (2, 5), (None, 1)]


def test_lookup_never_doubles_rows(spark):
    rows = spark.sql("select * from values (1),(1),(3),(null) as r(key)")
    names = spark.sql("select * from values (1,'b'),(1,'a'),(2,'c'),(null,'n') as n(key,name)")
    found = look_up(rows, "key", names, "label")
    assert rows_of(found) == [(1, "a"), (1, "a"), (3, None), (None, None)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_with_a_reduced_side_equals_the_plain_join(spark, how):
    rows = spark.sql("select * from values (1,'a'),(1,'a'),(2,'b'),(3,null),(null,'c') as r(k,t)")
    reduced = spark.sql("select * from values (1,'x'),(2,'y'),(null,'z') as d(k,v)")
    plain = rows.join(reduced, "k", how)
    assert rows_of(join_reduced(rows, reduced, ["k"], how)) == rows_of(plain)
    with pytest.raises(TypeError, match="k"):
        join_reduced(rows, reduced.withColumn("k", F.col("k").cast("bigint")), ["k"], how)


def test_a_hot_key_is_split_although_the_other_side_is_grouped(spark):
    rows = spark.range(0, 60_000, 1, 8).selectExpr("if(id % 3 = 0, 0, id) as k", "sha2(string(id), 256) as t")
    names = spark.range(0, 60_000, 1, 8).selectExpr("id as n", "concat('name', id) as name")
    found = look_up(rows, "k", names, "label")
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__shuffle__partitions="8",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="40KB",
    ):
        labels = [row.label for row in found.collect()]
        plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(labels) == 60_000 and labels.count("name0") == 20_000
    assert "skew=true" in plan
