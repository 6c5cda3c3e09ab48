"""Readers and writers: footers, lookup files, annotation files; estimates of counts."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

import plumbline as pl
from plumbline.plans import counts
from plumbline.plans.scratch import scratch_path

SF_DIR = "/root/testdata/sf0.01"


def test_footers_answer_without_reading_a_column(spark):
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    with pl.pushed_aggregates(spark):
        found = pl.footer_aggregate(spark, f"{SF_DIR}/orders.parquet", ["o_orderkey", "o_custkey"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        row = found.first()
    pushed = "COUNT(*), MIN(o_orderkey), MAX(o_orderkey), MIN(o_custkey), MAX(o_custkey)"
    assert f"PushedAggregation: [{pushed}]" in plan
    read = plan.split("ReadSchema: struct<")[1].split("> ")[0]
    assert all("(" in field for field in read.split(",")), "only statistics are read"
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    assert tuple(row) == tuple(orders.agg(
        F.count(F.lit(1)), F.min("o_orderkey"), F.max("o_orderkey"), F.min("o_custkey"),
        F.max("o_custkey")).first())
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before


def test_footers_of_empty_and_unbounded_columns(spark, tmp_path):
    path = str(tmp_path / "empty")
    spark.range(0).write.parquet(path)
    found = pl.bounds_from_footers(spark, [(path, "id")]).first()
    assert (found.row_count, found.min_value, found.max_value) == (0, None, None)
    with pytest.raises(ValueError, match="no exact bounds"):
        pl.bounds_from_footers(spark, [(f"{SF_DIR}/orders.parquet", "o_orderstatus")])


def _rows_out_of_the_scan(df):
    """How many rows the file scan gave, after row groups were skipped."""
    df._jdf.collectToPython()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaf = plan.collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value()


def test_lookups_skip_row_groups(spark, tmp_path):
    """By sorted bounds and by Bloom filter; a plain file is read whole."""
    rows = spark.range(200_000).select(
        F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("name"), F.lit("x" * 40).alias("pad")
    )
    plain, laid_out = str(tmp_path / "plain"), str(tmp_path / "laid_out")
    rows.orderBy(F.xxhash64("id")).coalesce(1).write.parquet(plain)
    pl.write_lookup_files(rows, laid_out, "id", ["name"], row_group_bytes=1 << 20, values_per_file=100_000)
    name = rows.filter("id = 4242").first()["name"]
    for column, value in (("id", 4242), ("name", name)):
        few = pl.lookup_by_name(spark.read.parquet(laid_out), column, value)
        assert few.select("id").collect() == [(4242,)]
        assert _rows_out_of_the_scan(few) < 40_000
    whole = pl.lookup_by_name(spark.read.parquet(plain), "name", name)
    assert _rows_out_of_the_scan(whole) > 100_000
    nowhere = pl.lookup_by_name(spark.read.parquet(laid_out), "name", "0" * 64)
    assert _rows_out_of_the_scan(nowhere) == 0


def test_lines_of_annotations_and_what_cannot_be_read(spark, rows, tmp_path):
    good = [json.dumps({"constraints": [{"id": str(n), "objectName": f"T{n}", "addedAt": "soon"}]}) for n in range(3)]
    path = tmp_path / "notes.json"
    path.write_text("\n".join([good[0], "{broken", good[1], '{"constraints": 7}', good[2], '{"constraints": []}']))
    found = pl.read_annotations(spark, str(path), lines=True)
    assert rows(found, "id", "object_name", "added_at") == [
        ("0", "T0", None), ("1", "T1", None), ("2", "T2", None)]
    broken = pl.unreadable_annotations(spark, str(path), lines=True)
    assert rows(broken, "record") == [('{"constraints": 7}',), ("{broken",)]
    assert broken.first()["file"].endswith("notes.json")


def test_top_counts_are_within_the_bound(spark, monkeypatch):
    """More values than the sketch keeps: a hot one among them is found within the bound."""
    monkeypatch.setattr(counts, "TRACKED_VALUES", 200)
    n = F.col("id")
    df = spark.range(60_000).select(
        F.when(n % 5 == 0, 7).otherwise(n).alias("hot"),
        F.when(n % 3 > 0, None).otherwise(F.concat(F.lit("v"), n % 30_000)).alias("text"),
        F.lit(None).cast("int").alias("nothing"),
    )
    exact = {r["column"]: r for r in counts.column_counts(df, df.columns).collect()}
    about = {r["column"]: r for r in counts.column_counts(df, df.columns, approx=True).collect()}
    bound = 60_000 * counts.SKETCH_ERROR / 200
    for name, row in exact.items():
        assert abs(about[name]["top_count"] - row["top_count"]) <= bound
        assert (about[name]["total"], about[name]["nulls"]) == (row["total"], row["nulls"])
        assert abs(about[name]["distinct_count"] - row["distinct_count"]) <= 0.05 * row["distinct_count"]
    assert about["nothing"]["top_count"] == 0
    empty = counts.column_counts(df.limit(0), ["hot"], approx=True).first()
    assert (empty["total"], empty["distinct_count"], empty["top_count"]) == (0, 0, 0)
    plan = counts.column_counts(df, df.columns, approx=True)._jdf.queryExecution().executedPlan()
    assert "hashpartitioning" not in plan.toString()


def test_intermediate_tables_need_a_shared_folder(spark):
    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, name, default=None):
            return self.values.get(name.replace("spark.", "").replace(".", "_"), default)

    class Session:
        def __init__(self, **values):
            self.conf = Conf(**values)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Session(master="yarn"), "x")
    assert scratch_path(Session(master="yarn", checkpoint_dir="hdfs:/c/"), "x").startswith("hdfs:/c/plumbline-x-")
    assert "plumbline-x-" in scratch_path(Session(master="local[2]"), "x")
