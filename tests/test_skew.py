"""One key with a third of all rows, and plans without any broadcast join."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import plumbline as pl
from plumbline.plans import sequences

SF_DIR = "/root/testdata/sf0.001"

JOINING = [
    "activity_rates", "annotate_rows", "check_rules", "column_profile",
    "customer_priorities", "feed_orphans", "find_references", "grant_listing",
    "impact_ranking", "last_access", "latest_run", "mention_report",
    "multi_event_groups", "prefix_covered_lists", "recent_failures", "run_history",
    "snapshot_drift", "unreferenced_orders",
]


@pytest.fixture
def shuffled_joins(spark):
    """Small partitions count as skewed, and no side is broadcast by itself."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.shuffle.partitions": "7",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture(scope="module")
def with_broadcasts(spark):
    return {
        name: sorted(map(repr, contract.queries()[name](spark, SF_DIR).collect()))
        for name in JOINING
    }


@pytest.mark.parametrize("name", JOINING)
def test_same_result_when_nothing_is_broadcast(
    spark, with_broadcasts, shuffled_joins, name
):
    found = contract.queries()[name](spark, SF_DIR).collect()
    assert sorted(map(repr, found)) == with_broadcasts[name]


@pytest.fixture(scope="module")
def hot(spark):
    """30,000 rows; key 0 has a third of them, the others share the rest."""
    n = F.col("id")
    return spark.range(30000).select(
        F.when(n % 3 == 0, 0).otherwise(n % 1000 + 1).alias("k"),
        n.alias("o"),
        F.when(n % 7 == 0, -n).otherwise(n).alias("v"),
        F.concat(F.lit("n"), n % 5000).alias("name"),
    )


def test_hot_group_in_reports(spark, hot, rows, shuffled_joins):
    top = pl.duplicate_groups(hot, ["k"], top=1).first()
    assert (top.k, top.duplicate_count) == (0, 10000)

    link = pl.missing_references([pl.Link("l", hot, "k", spark.range(500), "id")]).first()
    keys = hot.select("k").distinct().count()
    orphans = hot.filter("k >= 500").select("k").distinct().count()
    assert (link.child_rows, link.child_keys, link.orphan_keys) == (30000, keys, orphans)

    share = pl.share_of_total(hot, "k", F.lit(1)).first()
    assert (share.k, share.events, share.pct_total) == (0, 10000, 33.33)


@pytest.mark.parametrize("width", [None, 500])
def test_hot_group_out_of_order(hot, width, shuffled_joins):
    block = F.floor(F.col("o") / width) if width else None
    found = pl.clustering_fragmentation(hot, "k", ["o"], "v", min_rows=1000, low=1, block=block)
    values = [-o if o % 7 == 0 else o for o in range(0, 30000, 3)]
    bad = sum(b < a for a, b in zip(values, values[1:]))
    assert [tuple(r) for r in found.collect()] == [(0, 10000, round(bad / 100, 1), "REORGANIZE")]


def test_hot_group_names_are_listed_one_by_one(hot, shuffled_joins):
    own = pl.multi_event_groups(hot, "k", "name").filter("k = 0").collect()
    names = [row.name for row in own]
    expected = {f"n{o % 5000}" for o in range(0, 30000, 3)}
    assert len(names) == len(set(names)) and set(names) == expected
    assert {row.entities for row in own} == {len(expected)}


def test_hot_list_is_matched_in_blocks(spark, hot, rows, shuffled_joins):
    """The hot list begins with the other list of its group."""
    whole = hot.filter("k = 0").select(F.lit("g").alias("g"), F.lit(1).alias("i"), "o", "v")
    start = whole.filter("o < 12000").withColumn("i", F.lit(2))
    other = start.withColumn("i", F.lit(3)).withColumn("v", F.col("v") + (F.col("o") == 11997).cast("int"))
    found = pl.prefix_covered_lists(
        whole.union(start).union(other), "g", "i", ["o"], "v",
        block=F.floor(F.col("o") / 1000),
    )
    assert rows(found) == [("g", 2, 1, 1)]


@pytest.mark.parametrize("longest", [400, 9_999, 10_000])
def test_hot_group_out_of_order_without_a_block(hot, rows, longest, shuffled_joins):
    whole = pl.clustering_fragmentation(hot, "k", ["o"], "v", min_rows=1, low=-1)
    split = pl.clustering_fragmentation(hot, "k", ["o"], "v", min_rows=1, low=-1, longest=longest)
    assert rows(split) == rows(whole)


def test_hot_list_is_matched_in_ranges(spark, hot, rows, shuffled_joins):
    whole = hot.filter("k = 0").select(F.lit("g").alias("g"), F.lit(1).alias("i"), "o", "v")
    start = whole.filter("o < 12000").withColumn("i", F.lit(2))
    other = start.withColumn("i", F.lit(3)).withColumn("v", F.col("v") + (F.col("o") == 11997).cast("int"))
    short = start.filter("o < 60").withColumn("i", F.lit(None).cast("int"))
    lists = whole.union(start).union(other).union(short)
    for longest in (50, 3_000, 5_000):
        found = pl.prefix_covered_lists(lists, "g", "i", ["o"], "v", longest=longest)
        assert rows(found) == rows(pl.prefix_covered_lists(lists, "g", "i", ["o"], "v"))
        assert ("g", 2, 1, 1) in rows(found) and ("g", None, 1, 3) in rows(found)


def test_ranges_of_a_hot_group_are_even(spark, hot):
    """A third of all rows in one group: its ranges hold about as many rows each."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        keyed = hot.select(F.struct("k").alias("_key"), F.col("o").alias("_order0"))
        short, long = sequences.split_long(keyed, ["_order0"], 1000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert short.count() == 20000
    sizes = sorted(r["count"] for r in long.groupBy("_block").count().collect())
    assert len(sizes) > 2 and sum(sizes) == 10000
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
