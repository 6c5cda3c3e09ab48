"""Profiles, duplicates and rules on small inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import plumbline as pl


def _profile(df, column, **options):
    return pl.column_profile(df, column, **options).first().asDict()


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "n int, t string")
    for column in ("n", "t"):
        got = _profile(df, column)
        assert (got["total"], got["null_pct"], got["distinct_count"]) == (0, 0.0, 0)
        assert got["min_value"] is None and got["max_len"] is None


def test_profile_of_nulls_and_trailing_blanks(spark):
    df = spark.createDataFrame([(None, "ab  "), (None, "abc"), (None, None)], "n int, t string")
    nulls = _profile(df, "n")
    assert (nulls["non_null"], nulls["nulls"], nulls["null_pct"]) == (0, 3, 100.0)
    text = _profile(df, "T", declared_lengths={"t": 8})
    assert (text["max_len"], text["avg_len"], text["null_pct"]) == (3, 2.5, 33.3)
    assert text["oversized"] is True
    assert _profile(df, "t", declared_lengths={"t": 7})["oversized"] is False


def test_profile_order_of_numbers(spark):
    df = spark.createDataFrame([(9,), (10,)], "n int")
    assert _profile(df, "n")["max_value"] == "10"
    assert _profile(df, "n", text_order=True)["max_value"] == "9"


def test_profile_null_percent_rounds_half_even(spark):
    df = spark.range(400).select(F.when(F.col("id") > 0, 1).alias("n"))
    assert _profile(df, "n")["null_pct"] == 0.2  # 0.25 exactly
    df = spark.range(400).select(F.when(F.col("id") > 2, 1).alias("n"))
    assert _profile(df, "n")["null_pct"] == 0.8  # 0.75 exactly


def test_profile_counts_long_texts_and_approximates(spark):
    df = spark.range(300).select(F.repeat(F.col("id").cast("string"), 100).alias("t"))
    assert _profile(df, "t")["distinct_count"] == 300
    assert abs(_profile(df, "t", approx=True)["distinct_count"] - 300) < 45


def test_profile_distinct_of_special_doubles(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),)], "d double")
    assert _profile(df, "d")["distinct_count"] == 2


def test_profile_names_with_dots(spark):
    df = spark.createDataFrame([(1,), (1,)], ["a.b"])
    assert _profile(df, "a.b")["distinct_count"] == 1


def test_unknown_column_is_an_error(spark):
    with pytest.raises(ValueError, match="not found: nope"):
        pl.column_profile(spark.range(1), "nope")


def test_nullable_without_nulls(spark, rows):
    df = spark.createDataFrame([(1, None, "x"), (2, None, None)], "a int, b int, c string")
    assert rows(pl.nullable_without_nulls(df)) == [("a", False)]
    assert rows(pl.nullable_without_nulls(df, candidates_only=False)) == [
        ("a", False), ("b", True), ("c", True)
    ]
    assert rows(pl.nullable_without_nulls(df.limit(0), ["c"])) == [("c", False)]
    assert pl.nullable_without_nulls(spark.range(2)).count() == 0


def test_duplicates_group_nulls_and_order_ties(spark):
    df = spark.createDataFrame(
        [(None, 1), (None, 1), ("b", 1), ("b", 1), ("a", 1), ("a", 1), ("a", 1), ("z", 1)],
        "k string, v int",
    )
    found = pl.duplicate_groups(df, ["K"])
    assert [tuple(r) for r in found.collect()] == [("a", 3), (None, 2), ("b", 2)]
    assert pl.duplicate_groups(df, ["k"], top=1).count() == 1
    assert pl.duplicate_groups(df, ["k"], top=None).count() == 3
    with pytest.raises(ValueError):
        pl.duplicate_groups(df, ["k"], top=0)
    assert pl.duplicate_groups(df.filter("k = 'z'"), ["k"]).count() == 0
    assert pl.duplicate_groups(df.limit(0), ["k"]).count() == 0


def test_duplicates_of_long_and_short_texts(spark, rows):
    long_a, long_b = "a" * 500, "b" * 500
    fake = "sha256:" + "0" * 57  # short enough to be a key of its own
    data = [(long_a, 1)] * 3 + [(long_b, 1), (long_b, 2)] + [("x", None)] * 2 + [(fake, 1)] * 2
    df = spark.createDataFrame(data, "t string, n int")
    assert rows(pl.duplicate_groups(df, ["t", "n"])) == sorted(
        [(long_a, 1, 3), ("x", None, 2), (fake, 1, 2)], key=repr
    )
    cut = pl.duplicate_groups(df, ["t"], max_width=25)
    assert ("a" * 22 + "...", 3) in rows(cut)


def test_duplicates_need_columns(spark):
    for columns in ([], ["nope"]):
        with pytest.raises(ValueError):
            pl.duplicate_groups(spark.range(1), columns)


def test_one_more_copy_adds_one_to_one_group(spark, rows):
    df = spark.createDataFrame([(i % 4,) for i in range(20)], "k int")
    before = dict(rows(pl.duplicate_groups(df, ["k"])))
    after = dict(rows(pl.duplicate_groups(df.union(df.limit(1)), ["k"])))
    assert sum(after.values()) == sum(before.values()) + 1
    assert sum(after[k] != before[k] for k in before) == 1


@pytest.mark.parametrize(
    "last, pct, flag",
    [(699, 69.9, ""), (700, 70.0, "WARNING"), (899, 89.9, "WARNING"), (900, 90.0, "CRITICAL")],
)
def test_key_capacity_flags(spark, last, pct, flag):
    df = spark.createDataFrame([(1,), (last,)], "k int")
    got = pl.key_capacity([pl.KeyColumn("t", df, "k", cap=1000, seed=1)]).first()
    assert (got.used_pct, got.flag) == (pct, flag)


def test_key_capacity_types_and_empty_columns(spark, rows):
    df = spark.createDataFrame([], "s smallint, b bigint")
    report = pl.key_capacity([pl.KeyColumn("t", df, "s"), pl.KeyColumn("t", df, "b")])
    assert rows(report, "column", "cap", "used_pct", "flag") == [
        ("b", 9223372036854775807, 0.0, ""), ("s", 32767, 0.0, "")
    ]
    with pytest.raises(ValueError, match="not an integer"):
        pl.key_capacity([pl.KeyColumn("t", spark.sql("SELECT 1.5D AS d"), "d")])


def test_dataset_summary(spark):
    tables = {
        "keyed": spark.range(5).toDF("id"),
        "repeated": spark.createDataFrame([(1,), (1,)], "id int"),
        "nulls": spark.createDataFrame([(1,), (None,), (None,)], "id int"),
        "keyless": spark.range(9),
        "empty": spark.createDataFrame([], "id int"),
    }
    keys = {name: ["id"] for name in ("keyed", "repeated", "nulls", "empty")}
    got = dict(map(tuple, pl.dataset_summary(tables, keys, top=2).collect()))
    assert got == {
        "table_count": 5, "total_rows": 19, "tables_without_unique_key": 3,
        "tables_with_null_keys": 1, "rows:keyless": 9, "rows:keyed": 5,
    }


def test_check_rules_pass_unknown(spark, rows):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "v int")
    report = pl.check_rules(
        {"t": df},
        [pl.CheckRule("bad", "t", "v > 0"), pl.CheckRule("good", "t", "v < 9"),
         pl.CheckRule("off", "t", "v > 0", enabled=False)],
    )
    assert rows(report, "rule", "checked", "violations", "trusted") == [
        ("bad", 3, 1, False), ("good", 3, 0, True), ("off", None, None, False)
    ]
    with pytest.raises(ValueError, match="Unknown table"):
        pl.check_rules({"t": df}, [pl.CheckRule("r", "u", "true")])


def test_layout_candidates(spark, rows):
    df = spark.createDataFrame([(1, "x", 1), (2, "x", 1), (3, None, 1), (4, "y", 1)], "userId int, Status string, n int")
    assert rows(pl.layout_candidates({"t": df})) == [
        ("t", "Status", 2, 0.5, 0.5), ("t", "userId", 4, 1.0, 0.25)
    ]
    assert rows(pl.layout_candidates({"t": df}, laid_out=[("T", "userid")]), "column") == [("Status",)]


def test_schema_profile(spark):
    df = spark.createDataFrame([(1, "a", [1]), (2, None, [1])], "id int, t string, a array<int>")
    got = [tuple(r) for r in pl.table_schema_profile(df, ["ID"]).collect()]
    assert got == [
        (1, "id", "int", True, 0, 2, True, True),
        (2, "t", "string", True, 1, 1, False, False),
        (3, "a", "array<int>", True, 0, 1, False, False),
    ]


def test_tied_duplicates_go_by_text_at_any_length(spark):
    """Texts on both sides of the length from which digests are counted."""
    texts = ["bbb", "a" * 80, "m" * 80, "zzz", "a" * 64, "a" * 65]
    df = spark.createDataFrame([(t,) for t in texts * 2] + [("top",)] * 3, "t string")
    ranked = ["top", *sorted(texts)]
    for top in (1, 3, 4, None):
        found = [r.t for r in pl.duplicate_groups(df, ["t"], top=top).collect()]
        assert found == ranked[:top]


def test_no_number_of_duplicates_is_cut(spark):
    df = spark.range(800).selectExpr("concat('k', id % 400) AS k")
    assert pl.duplicate_groups(df, ["k"], top=1000).count() == 400


def test_estimated_profiles_have_the_shape_of_exact_ones(spark):
    df = spark.range(50).selectExpr("id", "id % 5 AS five", "cast(null AS string) AS t")
    exact = pl.table_schema_profile(df, ["id"])
    near = pl.table_schema_profile(df, ["id"], approx=True)
    assert exact.schema.names == near.schema.names
    assert [r.nulls for r in near.collect()] == [0, 0, 50]
    assert [r.distinct_count for r in near.collect()][1] == 5
    layout = pl.layout_candidates({"t": df}, names=["five"], approx=True).collect()
    assert {r.column: r.top_share for r in layout} == {"id": 0.02, "five": 0.2}
    plan = exact._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 50") == 1
