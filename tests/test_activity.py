"""Activity, cost and share reports on small inputs."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import plumbline as pl

T0 = datetime(2024, 1, 1)
LOG = "user int, type string, at timestamp_ntz"
READ, WRITE = ("r",), ("w",)


def _is(kinds):
    return F.col("type").isin(*kinds)


def test_role_lists(spark, rows):
    people = spark.createDataFrame([("a",), ("b",), ("dbo",)], "who string")
    roles = spark.createDataFrame([("a", "x"), ("a", "w"), ("a", "x"), ("z", "q")], "m string, role string")
    assert rows(pl.role_lists(people, "who", roles, "m", "role", ["dbo"])) == [
        ("a", "w, x"), ("b", "(none)")
    ]


def test_event_flags_label_order(spark, rows):
    events = spark.createDataFrame([(1, "UPDATE"), (1, "INSERT"), (2, "other")], "t int, e string")
    labels = {"INSERT": "INS", "UPDATE": "UPD", "DELETE": "DEL"}
    assert rows(pl.event_flags(events, ["t"], "e", labels)) == [
        (1, 1, 1, 0, "INS,UPD"), (2, 0, 0, 0, "")
    ]


def test_event_flags_on_a_stream(spark, rows, tmp_path):
    source = f"{tmp_path}/events"
    spark.createDataFrame([(1, "i"), (1, "u"), (2, "u")], "t int, e string").write.parquet(source)
    stream = spark.readStream.schema("t int, e string").parquet(source)
    flags = pl.event_flags(stream, ["t"], "e", {"i": "INS", "u": "UPD"})
    query = (
        flags.writeStream.format("memory").queryName("flags").outputMode("complete")
        .option("checkpointLocation", f"{tmp_path}/checkpoint").start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert rows(spark.table("flags"), "t", "label") == [(1, "INS,UPD"), (2, "UPD")]


def test_rates_use_at_least_one_day(spark, rows):
    users = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    log = spark.createDataFrame(
        [(1, "r", T0), (1, "r", T0 + timedelta(hours=6)), (2, "x", T0), (9, "r", T0)], LOG
    )
    rates = pl.activity_rates(users, "id", log, "user", "at", _is(READ), _is(WRITE))
    assert rows(rates) == [(1, 2, 0, 2.0, 0.0)]
    later = pl.activity_rates(
        users, "id", log, "user", "at", _is(READ), _is(WRITE), as_of=T0 + timedelta(days=4)
    )
    assert rows(later) == [(1, 2, 0, 0.5, 0.0)]


def test_last_access_order(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    log = spark.createDataFrame(
        [(1, "r", T0), (1, "w", T0 + timedelta(days=3)), (2, "r", T0 + timedelta(days=1))], LOG
    )
    found = pl.last_access(users, "id", log, "user", "at", _is(READ), _is(WRITE)).collect()
    assert [r.id for r in found] == [3, 2, 1]
    assert found[0].last_read is None and found[1].last_write is None


def test_multi_event_groups_are_one_row_per_entity(spark, rows):
    events = spark.createDataFrame(
        [("d1", str(i)) for i in range(25)] * 2 + [("d2", "only")], "day string, who string"
    )
    found = pl.multi_event_groups(events, "day", "who")
    assert rows(found) == sorted(("d1", 25, str(i)) for i in range(25))


@pytest.mark.parametrize("longest, shown", [(2, "a, b"), (1, "(2 roles)")])
def test_long_role_lists_give_their_number(spark, rows, longest, shown):
    members = spark.createDataFrame([(1,), (2,)], "id int")
    roles = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a")], "m int, r string")
    lists = pl.role_lists(members, "id", roles, "m", "r", longest=longest)
    assert rows(lists) == [(1, shown), (2, "(none)")]
    assert rows(pl.member_roles(members, "id", roles, "m", "r")) == [(1, "a"), (1, "b"), (2, None)]


def test_sums_are_exact_at_any_scale(spark):
    small = spark.range(1000).select(F.lit("k").alias("k"), F.lit("0.004").cast("decimal(9,4)").alias("c"))
    data = small.unionByName(spark.createDataFrame([("one",)], "k string").select("k", F.lit("0.01").cast("decimal(9,4)").alias("c")))
    top = pl.share_of_total(data, "k", F.col("c")).first()
    assert (top.k, top.total, top.pct_total) == ("k", 4.0, 99.75)
    big = spark.createDataFrame([("k", 1e17), ("k", 1.0)], "k string, c double")
    assert pl.share_of_total(big, "k", F.col("c")).first().total == 1e17
    log = big.select("k", "c", F.lit(2**62).alias("m"), F.lit(1).alias("at"), F.lit("t").alias("t"))
    cost = pl.top_by_cost(log, "k", F.col("c"), F.col("m"), "at", F.col("t")).first()
    assert (cost.total_cost, cost.total_measure) == (1e17, float(2**63))


def test_impact_multiplies_as_doubles(spark):
    costs = spark.createDataFrame([(1, 0.00004)], "k int, c double")
    lines = spark.createDataFrame([(1, 2e6, 10**11, 0)], "k int, b double, x bigint, y bigint")
    found = pl.impact_ranking(costs, lines, "k", "c", "b", "x", "y").first()
    assert (found.hits, found.score) == (10**11, 8e12)
    apart = pl.impact_ranking(costs, lines, "k", "c", "b", "x", "y", hits=lines).first()
    assert apart == found


def test_multi_event_entities(spark, rows):
    events = spark.createDataFrame([("d", 1, "b"), ("d", 1, "a"), ("d", 1, "a"), ("d", 2, "a")], "day string, who int, e string")
    assert rows(pl.multi_event_entities(events, "day", "who", "e")) == [("d", 1, 2, "a,b")]


def test_size_report_keeps_a_null_group_apart(spark, rows):
    df = spark.createDataFrame([(None, "é"), ("a", "xx"), ("a", None)], "g string, t string")
    assert rows(pl.size_report(df, "g", "t"), "g", "rows", "bytes", "is_total") == [
        ("a", 2, 2, False), (None, 1, 2, False), (None, 3, 4, True)
    ]
    assert rows(pl.size_report(df.limit(0), "g", "t"), "rows", "bytes", "is_total") in (
        [], [(0, 0, True)]
    )


@pytest.mark.parametrize("length, shown", [(200, 200), (201, 200)])
def test_cost_preview_is_cut(spark, length, shown):
    log = spark.createDataFrame(
        [("k", 1.5, 2.0, 1, "old"), ("k", 2.5, 4.0, 2, "y" * length)],
        "k string, c double, m double, at int, t string",
    )
    got = pl.top_by_cost(log, "k", F.col("c"), F.col("m"), "at", F.col("t")).first()
    assert (got.executions, got.total_cost, got.avg_cost, got.avg_measure) == (2, 4.0, 2.0, 3.0)
    assert len(got.preview) == shown
    assert got.preview.endswith("...") == (length > 200)


def test_cost_number_of_keys_and_missing_text(spark):
    log = spark.range(120).select(
        F.col("id").alias("k"), F.col("id").alias("c"), F.lit(1).alias("m"),
        F.lit(1).alias("at"), F.lit(None).cast("string").alias("t"),
    )
    args = ("k", F.col("c"), F.col("m"), "at", F.col("t"))
    assert pl.top_by_cost(log, *args, n=500).count() == 120
    assert pl.top_by_cost(log, *args, n=None).count() == 120
    first = pl.top_by_cost(log, *args, n=1).collect()
    assert [(r.k, r.preview) for r in first] == [(119, "(unavailable)")]


def test_share_of_total_zero_and_excluded(spark, rows):
    log = spark.createDataFrame([("a", 0.0), ("b", 3.0), ("c", 1.0)], "k string, v double")
    value = F.col("v")
    assert rows(pl.share_of_total(log, "k", value, ["c"])) == [
        ("a", 0.0, 1, 0.0), ("b", 3.0, 1, 100.0)
    ]
    assert rows(pl.share_of_total(log.filter("k = 'a'"), "k", value)) == [("a", 0.0, 1, None)]
    assert rows(pl.share_of_total(log, "k", value, ["a", "b", "c"])) == []


def test_impact_ranking_needs_all_sources(spark, rows):
    costs = spark.createDataFrame([(1, 2.0), (2, 9.0)], "k int, cost double")
    gains = spark.createDataFrame([(1, 10.0), (2, 1.0)], "k int, gain double")
    hits = spark.createDataFrame([(1, 1, 2)], "k int, seeks int, scans int")
    ranked = pl.impact_ranking(costs, gains, "k", "cost", "gain", "seeks", "scans", hits)
    assert rows(ranked) == [(1, 3, 60)]
