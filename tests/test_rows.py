"""Listing, sampling, search and lint on small inputs."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import plumbline as pl

AS_OF = datetime(2024, 1, 31, 12, 0, 0)


def test_inventory_lists_empty_tables(spark, rows):
    full = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    listing = pl.table_inventory({"full": full, "empty": full.filter("id < 0")})
    assert rows(listing) == [("empty", 0, 2), ("full", 2, 2)]


def test_inventory_name_filter_ignores_case(spark, rows):
    df = spark.range(3)
    listing = pl.table_inventory({"Orders": df, "parts": df}, name_filter="ORD")
    assert rows(listing) == [("Orders", 3, 1)]


def test_object_listing_filters_are_literal(spark, rows):
    names = spark.createDataFrame([("a_b",), ("aXb",), ("A_B2",)], "n string")
    entities = {"view": (names, "n"), "table": (names, "n")}
    listing = pl.object_listing(entities, type_filter="VIEW", name_filter="a_b")
    assert rows(listing) == [("view", "A_B2"), ("view", "a_b")]
    with pytest.raises(ValueError, match="Available: view, table"):
        pl.object_listing(entities, type_filter="index")


@pytest.mark.parametrize("asked, given", [(7, 7), (120, 120), (500, 150), (None, 150)])
def test_sample_gives_what_is_asked(spark, asked, given):
    assert pl.sample_rows(spark.range(150), ["id"], n=asked).count() == given


def test_sample_of_no_rows_is_refused(spark):
    with pytest.raises(ValueError):
        pl.sample_rows(spark.range(5), ["id"], n=0)


def test_run_reports_join_on_keys_of_one_name(spark, rows):
    jobs = spark.createDataFrame([(1, "load")], "id int, name string")
    runs = spark.createDataFrame(
        [(1, datetime(2024, 1, 2), 1, 0, 13005)],
        "id int, at timestamp_ntz, step int, status int, took int",
    )
    failed = pl.recent_failures(jobs, runs, ("id", "id"), F.col("status") == 0, "at")
    assert rows(failed, "id", "name") == [(1, "load")]
    history = pl.run_history(
        jobs, runs, ("id", "id"), "name", "load", "at", "step", "status", duration="took"
    )
    assert rows(history, "id", "status_label", "duration_seconds") == [(1, "FAILED", 5405)]


def test_markers_do_not_match_an_expanded_upper_case(spark, rows):
    df = spark.createDataFrame([(1, "pa\u00dfword"), (2, "PASSWORD")], "id int, t string")
    found = pl.text_complexity(df, "t", {"m": ["password"]}, ["m"])
    assert rows(found, "id", "has_m") == [(1, False), (2, True)]


def test_sample_cuts_long_values_and_shows_nulls(spark, rows):
    df = spark.createDataFrame(
        [(1, "x" * 30), (2, "x" * 31), (3, None)], "id int, t string"
    )
    assert rows(pl.sample_rows(df, ["id"])) == [
        ("1", "x" * 30), ("2", "x" * 27 + "..."), ("3", "NULL")
    ]


def test_search_treats_wildcards_literally(spark, rows):
    df = spark.createDataFrame([(1, "50%"), (2, "50 of"), (3, "a_c"), (4, "aBc")], "id int, t string")
    assert rows(pl.search_text(df, "t", "50%"), "id") == [(1,)]
    assert rows(pl.search_text(df, "t", "A_C"), "id") == [(3,)]


def test_lookup_by_name_and_kind(spark, rows):
    df = spark.createDataFrame([("f", "view", "v"), ("f", "proc", "p")], "n string, k string, body string")
    assert rows(pl.lookup_by_name(df, "n", "f", "k", "proc"), "body") == [("p",)]
    assert pl.lookup_by_name(df, "n", "F").count() == 0


def test_external_references_are_distinct_and_literal(spark, rows):
    df = spark.createDataFrame(
        [(1, 'href="/a.b" href="/a.b"'), (2, 'href="/axb"'), (3, None), (4, "none")],
        "id int, t string",
    )
    assert rows(pl.external_references(df, "id", "t")) == [(1, "/a.b"), (2, "/axb")]
    assert rows(pl.external_references(df, "id", "t", target="a.b")) == [(1, "/a.b")]


def test_keyword_guard_matches_whole_words(spark, rows):
    df = spark.createDataFrame(
        [(1, "update"), (2, "updated"), (3, "then UPDATE;"), (4, "last_update"),
         (5, "EXECUTE it"), (6, None)],
        "id int, t string",
    )
    assert rows(pl.keyword_guard(df, "t"), "id", "first_word", "blocked") == [
        (1, "update", True), (2, None, False), (3, "UPDATE", True),
        (4, None, False), (5, "EXECUTE", True), (6, None, False),
    ]


def test_text_complexity_limit_and_markers(spark, rows):
    df = spark.createDataFrame(
        [(1, "x\n" * 199), (2, "x\n" * 200), (3, ""), (4, None), (5, "declare Cursor"),
         (6, "with (nolock)"), (7, "into #t")],
        "id int, t string",
    )
    report = pl.text_complexity(df, "t")
    assert rows(report, "id", "lines", "review") == [
        (1, 200, False), (2, 201, True), (3, 1, False), (4, 1, False),
        (5, 1, True), (6, 1, False), (7, 1, False),
    ]
    assert rows(report.filter("has_temp_table"), "id") == [(7,)]
    assert rows(pl.text_complexity_totals(report)) == [(7, 2)]


def test_name_lint_rules(spark, rows):
    names = spark.createDataFrame(
        [("tbl_x",), ("x_OLD",), ("ABC",), ("A",), ("a_b",), ("Plain",), ("",), ("a_b",)],
        "name string",
    )
    assert rows(pl.name_lint(names)) == [
        ("all_caps", "ABC"), ("type_prefix", "tbl_x"), ("underscore", "a_b"),
        ("underscore", "x_OLD"), ("version_suffix", "x_OLD"),
    ]
    assert rows(pl.name_lint_counts(names)) == [
        ("all_caps", 1), ("type_prefix", 1), ("underscore", 2), ("version_suffix", 1)
    ]
    assert rows(pl.name_lint_counts(names, columns=True)) == [
        ("all_caps", 1), ("type_prefix", 1), ("underscore", 3)
    ]


def test_snapshots_can_be_left_out(spark, rows):
    names = spark.createDataFrame([("a_20240101_000000",), ("a",), (None,)], "n string")
    assert rows(pl.without_snapshots(names, "n")) == [("a",), (None,)]


def test_recent_changes_boundaries(spark, rows):
    edge = AS_OF - timedelta(days=30)
    data = [
        (1, edge - timedelta(days=9), edge),
        (2, edge - timedelta(days=9), edge - timedelta(seconds=1)),
        (3, AS_OF - timedelta(seconds=119), AS_OF),
        (4, AS_OF - timedelta(seconds=120), AS_OF),
    ]
    df = spark.createDataFrame(data, "id int, created timestamp_ntz, modified timestamp_ntz")
    changes = pl.recent_changes(df, "created", "modified", as_of=AS_OF)
    assert rows(changes, "id", "is_new") == [(1, False), (3, True), (4, False)]
    assert pl.recent_changes(df, "created", "modified").count() == 3
    assert pl.recent_changes(df, "created", "modified", days=0).count() == 2
    assert pl.recent_changes(df, "created", "modified", days=9999).count() == 4


def test_recent_failures_window_starts_at_midnight(spark, rows):
    jobs = spark.createDataFrame([(1, "load"), (2, "never")], "id int, job string")
    runs = spark.createDataFrame(
        [(1, "F", datetime(2024, 1, 24, 0, 0)), (1, "F", datetime(2024, 1, 23, 23, 59)),
         (1, "S", datetime(2024, 1, 30))],
        "job_id int, status string, at timestamp_ntz",
    )
    failures = pl.recent_failures(
        jobs, runs, ("id", "job_id"), F.col("status") == "F", "at", as_of=AS_OF
    )
    assert rows(failures, "job", "at") == [("load", datetime(2024, 1, 24))]


def test_run_history_order_and_labels(spark):
    jobs = spark.createDataFrame([(1, "load"), (2, "other")], "id int, job string")
    at = datetime(2024, 1, 1)
    runs = spark.createDataFrame(
        [(1, at, 2, 1), (1, at, 1, 0), (1, at + timedelta(1), 0, 5), (2, at, 0, 1), (1, at, 3, 9)],
        "job_id int, at timestamp_ntz, step int, status int",
    )
    history = pl.run_history(
        jobs, runs, ("id", "job_id"), "job", "load", "at", "step", "status", last_n=3
    )
    assert [(r.step, r.status_label) for r in history.collect()] == [
        (0, "Unknown"), (1, "FAILED"), (2, "Succeeded")
    ]


def test_packed_values(spark):
    from plumbline.functions import packed_seconds, packed_timestamp

    df = spark.createDataFrame(
        [(20240131, 93005, 13059), (20241399, 0, 0), (None, 1, None)], "d int, t int, n int"
    )
    found = df.select(
        packed_timestamp(F.col("d"), F.col("t")), packed_seconds(F.col("n"))
    ).collect()
    assert [tuple(r) for r in found] == [
        (datetime(2024, 1, 31, 9, 30, 5), 5459), (None, 0), (None, None)
    ]


def test_size_labels(spark):
    from plumbline.functions import size_label

    sizes = [(1023,), (1024,), (1024 * 1024,), (1536 * 1024,), (5 * 1024**3,)]
    df = spark.createDataFrame(sizes, "n bigint").select(size_label(F.col("n")))
    assert [r[0] for r in df.collect()] == ["0 KB", "1 KB", "1.0 MB", "1.5 MB", "5.0 GB"]


def test_dataset_names(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/Numbers.parquet")
    data = pl.Dataset(spark, str(tmp_path), ["Numbers"])
    assert data.table("numbers").count() == 3
    with pytest.raises(ValueError, match="Available: Numbers"):
        data.table("letters")
    typed = pl.Dataset(spark, str(tmp_path), {"Numbers": "id bigint"})
    assert typed.tables()["Numbers"].count() == 3


def test_read_annotations(spark, rows, tmp_path):
    entries = [
        {"id": "1", "database": "Sales", "objectName": "Orders", "type": "note",
         "description": "d", "addedAt": "2024-01-01T00:00:00Z"},
        {"id": "2", "database": "Hr", "objectName": "People", "type": "note",
         "description": "d", "addedAt": "2024-01-01T00:00:00Z"},
    ]
    path = tmp_path / "notes.json"
    path.write_text(json.dumps({"constraints": entries}, indent=1))
    assert rows(pl.read_annotations(spark, str(path)), "id") == [("1",), ("2",)]
    assert rows(pl.read_annotations(spark, str(path), "SALE"), "id") == [("1",)]
    assert rows(pl.read_annotations(spark, str(path), "people"), "id") == [("2",)]
