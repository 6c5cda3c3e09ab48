"""References, containment and ordered lists, against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import plumbline as pl
from plumbline.plans import containment_pairs, out_of_order_counts


def test_missing_references_counts(spark, rows):
    child = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (9,), (None,)], "id int")
    report = pl.missing_references(
        [
            pl.Link("some", child, "k", parent, "id"),
            pl.Link("none", child.filter("k > 5"), "k", parent, "id"),
        ]
    )
    assert rows(report) == [("none", 0, 0, 0, 1.0), ("some", 4, 3, 2, 0.3333)]


def test_reference_candidates_skip_keys_and_declared(spark):
    tables = {
        "orders": spark.createDataFrame([], "Id int, customerId int, note_id double, name string"),
        "lines": spark.createDataFrame([], "order_ID bigint, partId bigint"),
    }
    found = pl.reference_candidates(
        tables, keys=[("orders", "id")], declared=[("LINES", "partid")]
    )
    assert found == [("lines", "order_ID", "bigint"), ("orders", "customerId", "int")]


def test_unreferenced_ignores_null_references(spark, rows):
    things = spark.createDataFrame([(1,), (2,)], "id int")
    refs = spark.createDataFrame([(1,), (1,), (None,)], "ref int")
    assert rows(pl.unreferenced_rows(things, "id", refs, "ref")) == [(2,)]


def _random_corpus(seed):
    rng = random.Random(seed)
    words = ["a", "ab", "abc", "the", "cat", "Dog", "x1", "é", "of"]
    texts = []
    for i in range(60):
        n = rng.choice([0, 1, 2, 5, 30])
        gap = lambda: rng.choice([" ", "  ", "\n", "\t"])
        texts.append((i, "".join(rng.choice(words) + gap() for _ in range(n))))
    items = []
    for i in range(80):
        _, text = rng.choice(texts)
        if text:
            start = rng.randrange(len(text))
            items.append((i, text[start : start + rng.choice([1, 2, 3, 8, 20, 60])]))
        else:
            items.append((i, rng.choice(["", "zz", " "])))
    items += [(900, "CAT"), (901, None), (902, ""), (903, "the  cat")]
    return texts + [(99, None)], items


@pytest.mark.parametrize("seed", [1, 2])
def test_containment_equals_brute_force(spark, rows, seed):
    """With cut words and odd spacing."""
    texts, items = _random_corpus(seed)
    expected = sorted(
        (t, i) for t, text in texts for i, item in items
        if text is not None and item and item.lower() in text.lower()
    )
    found = containment_pairs(
        spark.createDataFrame(texts, "text_id int, text string"),
        spark.createDataFrame(items, "item_id int, item_text string"),
    )
    assert sorted(map(tuple, found.collect())) == expected


def test_containment_without_items(spark):
    texts = spark.createDataFrame([(1, "a b")], "text_id int, text string")
    items = spark.createDataFrame([(1, "")], "item_id int, item_text string")
    found = containment_pairs(texts, items)
    assert found.count() == 0 and found.columns == ["text_id", "item_id"]


def test_mention_report_boundary_and_self(spark, rows):
    views = spark.createDataFrame(
        [(1, "alpha_view", "x\n" * 99), (2, "beta_view", "x\n" * 100),
         (3, "gamma_view", "select from ALPHA_VIEW and gamma_view")],
        "id int, name string, body string",
    )
    report = pl.mention_report(
        views, "id", "body", views.select("id", "name"), "id", "name", same_things=True
    )
    assert rows(report) == [(1, 100, "", False), (2, 101, "", True), (3, 1, "1", True)]


def test_grant_listing_excludes_and_sorts(spark):
    facts = spark.createDataFrame([(1, 10, "SELECT"), (2, 10, "INSERT"), (1, 11, "SELECT")], "p int, o int, perm string")
    people = spark.createDataFrame([(1, "ann"), (2, "public")], "pid int, who string")
    things = spark.createDataFrame([(10, "t"), (11, "s")], "oid int, thing string")
    grants = pl.grant_listing(
        facts, people, things, ("p", "pid"), ("o", "oid"),
        {"who": ["dbo", "public"]}, ["thing", "who", "perm"],
    )
    assert [(r.thing, r.who, r.perm) for r in grants.collect()] == [
        ("s", "ann", "SELECT"), ("t", "ann", "SELECT")
    ]


def test_annotate_rows_filter_on_either_column(spark, rows):
    df = spark.createDataFrame([(1, "Sales", "x"), (2, "hr", "SALES"), (3, "hr", "y")], "k int, a string, b string")
    notes = spark.createDataFrame([(1, "n1")], "key int, note string")
    found = pl.annotate_rows(df, notes, ("k", "key"), "sal", ["a", "b"])
    assert rows(found, "k", "note", "annotated") == [(1, "n1", True), (2, None, False)]


def _prefix_pairs(lists):
    return sorted(
        ((g, a, b) for (g, a), x in lists.items() for (h, b), y in lists.items()
         if g == h and len(x) < len(y) and y[: len(x)] == x),
        key=repr,
    )


@pytest.mark.parametrize("blocked", [False, True])
def test_prefix_lists_equal_brute_force(spark, rows, blocked):
    rng = random.Random(5)
    lists = {
        (g, i): [rng.choice("ab") for _ in range(rng.randint(1, 9))]
        for g in ("t", None) for i in range(12)
    }
    lists |= {("u", 1): ["a"], ("u", 2): ["a", "b"], ("u", 3): ["a", "b", "c"],
              ("u", 4): ["b"], ("u", 5): ["a", "b"]}
    elements = [
        (g, i, pos, value.upper() if i % 2 else value)
        for (g, i), values in lists.items() for pos, value in enumerate(values)
    ]
    rng.shuffle(elements)
    df = spark.createDataFrame(elements, "g string, i int, pos int, v string")
    block = F.floor(F.col("pos") / 2) if blocked else None
    found = pl.prefix_covered_lists(df, "g", "i", ["pos"], "v", block, all_pairs=True)
    assert rows(found) == _prefix_pairs(lists)


@pytest.mark.parametrize("blocked", [False, True])
def test_prefix_lists_keep_elements_without_an_order(spark, rows, blocked):
    df = spark.createDataFrame(
        [("g", 1, None, "a"), ("g", 1, 1, "b"), ("g", 2, None, "a"), ("g", 2, 1, "b"),
         ("g", 2, 2, "c"), ("g", 3, 1, "b")],
        "g string, i int, pos int, v string",
    )
    block = F.floor(F.col("pos") / 2) if blocked else None
    found = pl.prefix_covered_lists(df, "g", "i", ["pos"], "v", block)
    assert rows(found) == [("g", 1, 2, 1)]


def test_latest_run_keeps_entities_without_runs(spark, rows):
    jobs = spark.createDataFrame([(1,), (2,)], "id int")
    runs = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 4, 9)], "job int, at int, seq int")
    found = pl.latest_run(jobs, runs, ("id", "job"), ["at", "seq"], ["seq"])
    assert rows(found) == [(1, 2, False), (2, None, True)]


@pytest.mark.parametrize("width", [None, 1, 3, 100])
def test_out_of_order_counts_do_not_depend_on_blocks(spark, rows, width):
    rng = random.Random(3)
    data = [(g, i, rng.randint(0, 5)) for g in "ab" for i in range(50)]
    expected = [
        (g, 50, sum(data[o + i][2] < data[o + i - 1][2] for i in range(1, 50)))
        for o, g in ((0, "a"), (50, "b"))
    ]
    df = spark.createDataFrame(data, "g string, o int, v int").repartition(5)
    block = F.floor(F.col("o") / width) if width else None
    assert rows(out_of_order_counts(df, ["g"], ["o"], "v", block)) == expected


def test_fragmentation_boundaries(spark, rows):
    def group(name, rows_, bad):
        values = list(range(rows_))
        for i in range(bad):
            values[2 * i], values[2 * i + 1] = values[2 * i + 1], values[2 * i]
        return [(name, i, v) for i, v in enumerate(values)]

    data = group("ten", 10, 1) + group("thirty", 10, 3) + group("some", 10, 2) + group("small", 9, 4)
    df = spark.createDataFrame(data, "g string, o int, v int")
    found = pl.clustering_fragmentation(df, "g", ["o"], "v", min_rows=10)
    assert rows(found) == [("some", 10, 20.0, "REORGANIZE"), ("thirty", 10, 30.0, "REBUILD")]


def test_covered_lists_count_equal_ones_once_each(spark, rows):
    """Equal lists are one class inside, and as many rows and coverers as they are."""
    lists = {1: "a", 2: "a", 3: "ab", 4: "ab", 5: "abc", 6: "b"}
    data = [("g", i, n, v) for i, text in lists.items() for n, v in enumerate(text)]
    df = spark.createDataFrame(data, "g string, i int, pos int, v string")
    expected = [("g", 1, 3, 3), ("g", 2, 3, 3), ("g", 3, 5, 1), ("g", 4, 5, 1)]
    for block in (None, F.floor(F.col("pos") / 2)):
        assert rows(pl.prefix_covered_lists(df, "g", "i", ["pos"], "v", block)) == expected


def test_a_block_against_the_order_raises(spark):
    df = spark.range(10).select(F.lit("g").alias("g"), F.lit(1).alias("i"), "id", F.lit("v").alias("v"))
    block = -F.floor(F.col("id") / 3)
    with pytest.raises(Exception, match="decreases along the order"):
        pl.prefix_covered_lists(df, "g", "i", ["id"], "v", block).collect()
    with pytest.raises(Exception, match="decreases along the order"):
        pl.clustering_fragmentation(df, "g", ["id"], "v", 1, block=block).collect()


def test_containment_of_null_and_repeated_ids(spark, rows):
    texts = spark.createDataFrame(
        [(None, "one two three four five six"), (1, "zero one two three four five six"),
         (1, "one two three four five six seven"), (2, "else")],
        "text_id int, text string",
    )
    items = spark.createDataFrame([(7, "two three four five")], "item_id int, item_text string")
    assert rows(containment_pairs(texts, items)) == [(1, 7), (None, 7)]


def test_short_items_of_common_words_make_few_candidates(spark):
    """300 items and 1000 texts that share their middle word only: one row per run pair at most."""
    texts = spark.range(1000).selectExpr("id AS text_id", "concat('t', id, ' the u', id) AS text")
    items = spark.range(300).selectExpr("id AS item_id", "concat('w', id, ' the v', id) AS item_text")
    found = containment_pairs(texts, items)
    assert found.count() == 0
    more = items.unionByName(
        spark.createDataFrame([(999, "t7 the u7")], "item_id bigint, item_text string")
    )
    assert sorted(map(tuple, containment_pairs(texts, more).collect())) == [(7, 999)] + [
        (n, 999) for n in range(10, 1000) if str(n).endswith("7") and f"t{n} the u{n}".find("t7 the u7") >= 0
    ]


def test_latest_run_reads_and_shuffles_the_log_once(spark):
    """However many order columns there are, and with texts among what is shown."""
    log = spark.range(100).selectExpr("id % 7 AS job", "id AS at", "id AS seq", "'t' AS name")
    jobs = spark.createDataFrame([(1,)], "id long")
    found = pl.latest_run(jobs, log, ("id", "job"), ["at", "seq", "name"], ["seq", "name"])
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("Range (0, 100") == 1
    assert text.count("hashpartitioning(") == 1
    # Reduced per task before that shuffle.
    assert text.count("partial_max(") == 1


def test_missing_references_compare_values_not_spellings(spark, rows):
    """Links of several types in one pass: columns that no link connects never meet."""
    a = spark.createDataFrame([(1, "1", 1.0, None), (2, "x", -0.0, "p"), (2, "1", 5.0, "q")],
                              "i int, s string, d double, n string")
    b = spark.createDataFrame([(1, "x", 0.0, "p"), (3, "y", 1.0, None)], "i long, s string, d double, n string")
    links = [pl.Link(c, a, c, b, c) for c in ("i", "s", "d", "n")]
    links.append(pl.Link("back", b, "i", a, "i"))
    found = pl.missing_references(links)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == sorted([
        ("i", 3, 2, 1, 0.5), ("s", 3, 2, 1, 0.5), ("d", 3, 3, 1, 0.6667),
        ("n", 2, 2, 1, 0.5), ("back", 2, 2, 1, 0.5)], key=repr)
    assert plan.count("Scan ExistingRDD") == 2 and plan.count("hashpartitioning") == 1


def test_missing_references_in_several_passes(spark, rows, monkeypatch):
    a = spark.createDataFrame([(1, 5), (2, 6)], "x int, y int")
    links = [pl.Link(f"{c}{p}", a, c, a, p) for c in "xy" for p in "xy"]
    whole = rows(pl.missing_references(links))
    monkeypatch.setattr("plumbline.operators.relations._COLUMNS_AT_ONCE", 3)
    assert rows(pl.missing_references(links)) == whole


@pytest.mark.parametrize("order", [["at"], ["at", "seq"]])
def test_latest_run_breaks_ties_and_keeps_nulls_last(spark, rows, order):
    jobs = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    runs = spark.createDataFrame(
        [(1, 5, 1), (1, 5, 3), (1, None, 9), (2, None, None)], "id int, at int, seq int"
    )
    found = pl.latest_run(jobs, runs, ("id", "id"), order, ["seq", "at"])
    assert rows(found) == [(1, 3, 5, False), (2, None, None, False), (3, None, None, True)]


def test_grants_join_on_keys_of_one_name(spark, rows):
    facts = spark.createDataFrame([(1, 10)], "id int, obj int")
    people = spark.createDataFrame([(1, "ann")], "id int, who string")
    things = spark.createDataFrame([(10, "box")], "obj int, what string")
    found = pl.grant_listing(facts, people, things, ("id", "id"), ("obj", "obj"), {}, ["id"])
    assert rows(found, "id", "who", "obj", "what") == [(1, "ann", 10, "box")]
