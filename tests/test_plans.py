"""Physical plans: what must not appear, and what must be pushed down."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as contract
import plumbline as pl
from plumbline.functions.shipping import ship_package
from plumbline.plans import containment, containment_pairs

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {name: contract.queries()[name] for name in contract.oracle_sql()}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_or_nested_loop_join(spark, name):
    plan = _plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_window_over_everything_and_no_python(spark, name):
    plan = _plan(QUERIES[name](spark, SF_DIR))
    for line in plan.splitlines():
        if "windowspecdefinition(" in line:
            spec = line.split("windowspecdefinition(", 1)[1]
            first = spec.split(",", 1)[0]
            assert " ASC" not in first and " DESC" not in first, line
    for operator in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroups"):
        assert operator not in plan


@pytest.mark.parametrize(
    "name, columns",
    [
        ("duplicate_line_keys", "struct<l_orderkey:bigint,l_linenumber:int>"),
        ("set_compare", "struct<o_custkey:bigint,o_orderdate:timestamp_ntz>"),
        ("table_inventory", "struct<>"),
        ("unreferenced_customers", "struct<user_id:bigint>"),
    ],
)
def test_only_needed_columns_are_read(spark, name, columns):
    assert f"ReadSchema: {columns}" in _plan(QUERIES[name](spark, SF_DIR))


def test_lookup_is_pushed_to_the_scan(spark):
    plan = _plan(QUERIES["lookup_by_name"](spark, SF_DIR))
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,42)]" in plan


def test_null_check_scans_once_without_a_data_shuffle(spark):
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    plan = _plan(pl.nullable_without_nulls(orders))
    assert plan.count("FileScan") == 1
    assert "hashpartitioning" not in plan


@pytest.mark.parametrize("name", ["search_text", "keyword_guard", "text_complexity"])
def test_text_scans_do_not_shuffle(spark, name):
    assert "Exchange" not in _plan(QUERIES[name](spark, SF_DIR))


@pytest.mark.parametrize(
    "name",
    ["sample_rows", "share_of_total", "share_of_suppliers", "run_history", "top_by_cost",
     "duplicate_groups", "duplicate_line_keys", "duplicate_texts"],
)
def test_top_rows_are_taken_per_partition(spark, name):
    assert "TakeOrderedAndProject" in _plan(QUERIES[name](spark, SF_DIR))


def test_containment_compares_no_pairs(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    texts = documents.selectExpr("doc_id AS text_id", "text")
    named = items.selectExpr("item_id", "text AS item_text")
    plan = _plan(containment_pairs(texts, named))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_logs_are_read_as_often_as_needed(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        impact = _plan(QUERIES["impact_ranking"](spark, SF_DIR))
        changes = _plan(QUERIES["recent_changes"](spark, SF_DIR))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert impact.count("lineitem.parquet") == 1
    assert changes.count("hashpartitioning(user_id") == 1


def test_long_texts_are_not_shuffled_to_count_them(spark):
    """Only digests and the top groups pass an exchange before the lookup."""
    plan = _plan(QUERIES["duplicate_texts"](spark, SF_DIR))
    keyed = [line for line in plan.splitlines() if "hashpartitioning(_k0" in line]
    assert keyed and "sha2" in plan


SHORT_ITEMS = ["the", "a", "on that", "thonble", "la de los ciudad", "é", "zz zz", "", None, "The"]


def _texts_and_items(spark, items, scale="0.1"):
    documents = spark.read.parquet(f"/root/testdata/sf{scale}/documents.parquet")
    frame = spark.createDataFrame(list(enumerate(items)), "item_id int, item_text string")
    return documents.selectExpr("doc_id AS text_id", "text"), frame


def test_few_windows_of_the_texts_become_rows(spark):
    """Of some 25 million characters, about one row for each text that holds a key."""
    texts, items = _texts_and_items(spark, ["thonble ently", "la de los ciudad", "zzzzzzzzzzzz"])
    ship_package(spark)
    lowered = texts.selectExpr("text_id", "lower(text) AS text").filter("text is not null")
    keys = containment._keyed(items, containment._window_counts(lowered, [8]))
    bloom = containment._bloom_filter(keys, 3)
    found = containment.text_windows(lowered, [8], bloom)
    rows = found.select("text_id", F.explode("hits")).count()
    truth = lowered.crossJoin(items).filter("contains(text, item_text)").count()
    assert truth <= rows <= truth + 2000


@pytest.mark.parametrize("most", [0, 8 << 20])
def test_short_items_are_found_both_ways(spark, most, monkeypatch):
    monkeypatch.setattr(containment, "BROADCAST_BYTES", most)
    texts, items = _texts_and_items(spark, SHORT_ITEMS, "0.01")
    found = containment_pairs(texts, items)
    plan = _plan(found)
    built = plan[plan.index("BroadcastExchange"):] if "BroadcastExchange" in plan else ""
    # Never the windows of the texts: they may be far more than the file's size tells.
    assert "hits" not in built.split("Scan")[0]
    assert ("SortMergeJoin" in plan) == (most == 0)
    want = texts.crossJoin(items).filter(
        "length(item_text) > 0 and contains(lower(text), lower(item_text))"
    ).select("text_id", "item_id").distinct()
    assert found.exceptAll(want).count() == 0 and want.exceptAll(found).count() == 0


def test_items_are_keyed_by_what_texts_have_least(spark):
    texts = spark.createDataFrame([(n, "common words here") for n in range(50)], "text_id int, text string")
    items = spark.createDataFrame([(1, "common words hexx")], "item_id int, item_text string")
    ship_package(spark)
    key = containment._keyed(items, containment._window_counts(texts, [8])).first()
    window = key["run"].to_bytes(8, "little", signed=True)
    assert b"x" in window


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab é", max_size=14), min_size=1, max_size=6),
       st.lists(st.text(alphabet="ab é", max_size=9), min_size=1, max_size=4))
def test_windows_in_the_filter_belong_to_one_text(texts, items):
    """What is found for a text is exactly its own windows that are keys."""
    column = pa.array(texts)
    for first, data, offsets in containment._slices(column):
        assert bytes(data) == "".join(texts).encode()
        for size, values in containment._windows(data, 8):
            for row, text in enumerate(texts):
                raw = text.encode()
                own = [int.from_bytes(raw[k:k + size], "little") for k in range(len(raw) - size + 1)]
                at = np.arange(offsets[row], max(offsets[row + 1] - size + 1, offsets[row]))
                assert values[at].tolist() == own
