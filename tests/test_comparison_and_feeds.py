"""Set, column and text comparison; landed feeds."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import plumbline as pl

AS_OF = datetime(2024, 2, 10, 12, 0, 0)


def _keys(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "k string")


def test_set_compare_ignores_case(spark, rows):
    a, b = _keys(spark, "Key", "x", "x", None), _keys(spark, "key", "y", None)
    assert rows(pl.set_compare(a, b, ["k"])) == sorted(
        [("Key", "both"), ("x", "only_a"), ("y", "only_b"), (None, "both")], key=repr
    )


def test_set_compare_with_itself_and_swapped(spark, rows):
    a, b = _keys(spark, "p", "q"), _keys(spark, "q", "r")
    assert {r[1] for r in rows(pl.set_compare(a, a, ["k"]))} == {"both"}
    swap = {"only_a": "only_b", "only_b": "only_a", "both": "both"}
    forward = rows(pl.set_compare(a, b, ["k"]))
    assert rows(pl.set_compare(b, a, ["k"])) == [(k, swap[s]) for k, s in forward]
    empty = pl.set_compare(a.limit(0), b, ["k"])
    assert rows(pl.set_compare_counts(empty)) == [("both", 0), ("only_a", 0), ("only_b", 2)]


def test_column_diff(spark, rows):
    a = spark.createDataFrame([(1, "x", 1), (2, None, 1)], "Id int, t string, gone int")
    b = spark.createDataFrame([(1, 2.0)], "id int, T double").withColumn("new", F.lit(1))
    got = {r.column: tuple(r)[1:] for r in pl.column_diff(a, b).collect()}
    assert got["Id"] == ("int", "int", 0, 0, 2, 1, "same")
    assert got["t"] == ("string", "double", 1, 0, 1, 1, "type")
    assert got["gone"] == ("int", None, 0, None, 1, None, "only_1")
    assert got["new"] == (None, "int", None, 0, None, 1, "only_2")
    nullable = pl.column_diff(a.select("Id"), spark.range(2).select(F.col("id").cast("int")))
    assert nullable.first().status == "nullability"


def test_text_version_diff(spark, rows):
    a = spark.createDataFrame([(1, "One two\ntwo"), (1, "three"), (2, "x"), (4, None)], "k int, t string")
    b = spark.createDataFrame([(1, "two FOUR"), (3, "")], "k int, t string")
    assert rows(pl.text_version_diff(a, b, "k", "t")) == [
        (1, True, True, 3, 1, 2, "a", 2, 1, 1),
        (2, True, False, 1, 0, None, None, None, None, None),
        (3, False, True, 0, 1, None, None, None, None, None),
    ]


NAMES = [
    "A_20240101_000000", "a_20240102_000000", "a_20240102_000000", "x_20241399_999999",
    "A", "lonely", "_20240101_000000", "A_20240101", None,
]


@pytest.fixture
def names(spark):
    return spark.createDataFrame([(n,) for n in NAMES], "name string")


def test_feed_inventory(names, rows):
    assert rows(pl.feed_inventory(names)) == [
        ("", 1, datetime(2024, 1, 1), datetime(2024, 1, 1), False),
        ("A", 2, datetime(2024, 1, 2), datetime(2024, 1, 1), True),
        ("x", 1, None, None, False),
    ]


def test_feed_orphans_and_totals(names, rows):
    assert rows(pl.feed_orphans(names)) == [("A_20240101",), ("lonely",)]
    assert rows(pl.feed_totals(names)) == [(3, 4, 2)]


def _landed(spark, feeds):
    data = [
        (f"{feed}_{moment:%Y%m%d_%H%M%S}",)
        for feed, ages in feeds.items() for moment in (AS_OF - age for age in ages)
    ]
    return spark.createDataFrame(data, "name string")


def test_feed_health_boundaries(spark):
    hour, second = timedelta(hours=1), timedelta(seconds=1)
    day = 24 * hour
    landed = _landed(
        spark,
        {
            "on_time": [day, 5 * day],
            "late": [day + second],
            "kept": [hour, 5 * day + second],
            "six": [i * hour for i in range(6)],
            "seven": [i * hour for i in range(7)],
            "bad": [6 * day + i * hour for i in range(7)],
        },
    ).union(spark.createDataFrame([("nodate_20241399_999999",)], "name string"))
    found = [(r.feed, r.flags) for r in pl.feed_health(landed, AS_OF).collect()]
    assert found == [
        ("bad", "OVERDUE, CLEANUP LATE, EXCESS"), ("kept", "CLEANUP LATE"),
        ("late", "OVERDUE"), ("seven", "EXCESS"),
    ]
    stopped = {r.feed for r in pl.feed_health(landed).collect() if "OVERDUE" in r.flags}
    assert stopped == {"on_time", "late", "kept", "six", "seven", "bad"}  # years ago by now


def test_snapshot_drift(spark, rows):
    snapshots = spark.createDataFrame(
        [("f", 1, "gone", "int"), ("f", 2, "Keep", "INT"), ("F", 2, "extra", "int"),
         ("f", 2, "size", "int"), ("f", None, "unparsed", "int"), ("g", None, "c", "int")],
        "feed string, snapshot int, column string, type string",
    )
    permanent = spark.createDataFrame(
        [("f", "keep", "int"), ("f", "size", "bigint"), ("f", "loaded_at", "date")],
        "feed string, column string, type string",
    )
    columns = pl.snapshot_drift_columns(snapshots, permanent)
    assert rows(columns, "column", "status") == [
        ("Keep", "identical"), ("c", "only_newest"), ("extra", "only_newest"),
        ("loaded_at", "only_permanent"), ("size", "mismatch"),
    ]
    assert rows(pl.snapshot_drift(snapshots, permanent)) == [("F", 1, 1, 1, 1), ("g", 1, 0, 0, 0)]


@pytest.mark.parametrize("parts", [1, 7])
def test_repartitioning_changes_nothing(names, rows, parts):
    moved = names.repartition(parts)
    assert rows(pl.feed_inventory(moved)) == rows(pl.feed_inventory(names))


def test_version_tokens_name_each_side(spark, rows):
    a = spark.createDataFrame([(1, "x  Y"), (2, None)], "k int, t string")
    b = spark.createDataFrame([(1, "y z"), (3, "q")], "k int, t string")
    assert rows(pl.text_version_tokens(a, b, "k", "t")) == [
        (1, "x", "only_a"), (1, "y", "both"), (1, "z", "only_b"), (3, "q", "only_b")
    ]
