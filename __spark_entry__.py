
from __future__ import annotations

import sys
import warnings
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import plumbline as pl  # noqa: E402
from plumbline.functions import packed_timestamp  # noqa: E402
from plumbline.plans.scratch import scratch_path  # noqa: E402

try:
    import corpus_pipeline  # noqa: E402
    from plumbline.llm import bindings as llm  # noqa: E402
except ModuleNotFoundError as missing:
    # The training-data package, or a library that only it needs, may be absent.
    if missing.name.split(".")[0] == "plumbline" and missing.name != "plumbline.llm":
        raise
    if missing.name not in ("corpus_pipeline", "plumbline.llm"):
        warnings.warn(f"no training-data queries: {missing.name} is not installed")
    corpus_pipeline = llm = None

TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, "
    "p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, "
    "l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
    "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"],
    "events": ["event_id"],
    "documents": ["doc_id"],
    "embeddings": ["vec_id"],
    "pages": ["page_id"],
    "benchmark": ["item_id"],
    "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"],
}

READ_TYPES = ("view", "click")
WRITE_TYPES = ("purchase", "signup")


def _data(spark: SparkSession, sf_dir: str) -> pl.Dataset:
    return pl.Dataset(spark, sf_dir, TABLES)


# --- rows, names and texts ------------------------------------------------------


def table_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.table_inventory(_data(spark, sf_dir).tables())


def inventory_from_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory from Parquet footers alone."""
    return pl.inventory_from_footers(spark, {t: f"{sf_dir}/{t}.parquet" for t in TABLES})


def bounds_from_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the keys from Parquet footers alone."""
    columns = [
        (f"{sf_dir}/{table}.parquet", column) for table, names in KEYS.items() for column in names
    ]
    found = pl.bounds_from_footers(spark, columns)
    return found.select("column", "row_count", "min_value", "max_value")


def object_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)
    entities = {
        "region": (data.table("region"), "r_name"),
        "nation": (data.table("nation"), "n_name"),
        "supplier": (data.table("supplier"), "s_name"),
        "customer": (data.table("customer"), "c_name"),
    }
    return pl.object_listing(entities, name_filter="1")


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.sample_rows(_data(spark, sf_dir).table("orders"), ["o_orderkey"], n=20)


def sample_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _data(spark, sf_dir).table("documents")
    return pl.sample_rows(documents.select("doc_id", "text", "lang"), ["doc_id"], n=100)


def lookup_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _data(spark, sf_dir).table("documents")
    return pl.lookup_by_name(documents, "doc_id", 42).select("doc_id", "text")


def lookup_by_name_and_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _data(spark, sf_dir).table("part")
    return pl.lookup_by_name(part, "p_name", "small ring", "p_type", "ECONOMY")


def lookup_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _data(spark, sf_dir).table("pages")
    url = "https://m.ththth.example.net/en/25#top"
    return pl.lookup_by_name(pages, "url", url)


def lookup_in_sorted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of a URL, from files with Bloom filters on it."""
    path = scratch_path(spark, "pages")
    pages = _data(spark, sf_dir).table("pages")
    pl.write_lookup_files(pages, path, "page_id", ["url"])
    url = "https://m.ththth.example.net/en/25#top"
    return pl.lookup_by_name(spark.read.schema(TABLES["pages"]).parquet(path), "url", url)


def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _data(spark, sf_dir).table("documents")
    return pl.search_text(documents, "text", "LICENSE").select("doc_id", "source")


def external_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.external_references(_data(spark, sf_dir).table("pages"), "page_id", "html")


def keyword_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _data(spark, sf_dir).table("documents")
    words = ["license", "licensed", "released", "token"]
    guarded = pl.keyword_guard(documents, "text", words)
    return guarded.select("doc_id", "first_word", "blocked")


def _complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.text_complexity(
        _data(spark, sf_dir).table("documents"),
        "text",
        markers={
            "license": ["license", "licence"],
            "contact": ["@"],
            "secret": ["token", "password", "api_key"],
        },
        serious=["secret"],
        max_lines=50,
    )


def text_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _complexity(spark, sf_dir).select(
        "doc_id", "lines", "has_license", "has_contact", "has_secret", "review"
    )


def text_complexity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.text_complexity_totals(_complexity(spark, sf_dir))


def page_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pl.text_complexity(
        _data(spark, sf_dir).table("pages"),
        "html",
        markers={"script": ["<script"], "table": ["<table", "<td"], "link": ["HREF="]},
        serious=["table"],
        max_lines=20,
    )
    return pages.select("page_id", "lines", "has_script", "has_table", "has_link", "review")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)
    return (
        data.table("nation").select(F.col("n_name").alias("name"))
        .unionByName(data.table("region").select(F.col("r_name").alias("name")))
        .unionByName(data.table("part").select(F.col("p_name").alias("name")))
        .unionByName(data.table("orders").select(F.col("o_orderpriority").alias("name")))
    )


def name_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.name_lint(_names(spark, sf_dir))


def column_name_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.name_lint(_names(spark, sf_dir), columns=True)


def column_name_lint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.name_lint_counts(_names(spark, sf_dir), columns=True)


def name_lint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.name_lint_counts(_names(spark, sf_dir))


def recent_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _data(spark, sf_dir).table("events")
    users = events.groupBy("user_id").agg(
        F.min("ts").alias("created"), F.max("ts").alias("modified")
    )
    # The latest change is the log's latest moment, found without grouping it again.
    as_of = events.agg(F.max("ts")).scalar()
    return pl.recent_changes(users, "created", "modified", days=1, as_of=as_of)


def recent_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)
    failures = pl.recent_failures(
        data.table("customer"),
        data.table("orders"),
        on=("c_custkey", "o_custkey"),
        failed=F.col("o_orderstatus") == "F",
        run_at="o_orderdate",
    )
    return failures.select("c_name", "o_orderkey", "o_orderdate")


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs, with date, duration and status packed the way run logs pack them."""
    data = _data(spark, sf_dir)
    at = F.col("o_orderdate")
    packed = F.year(at) * 10000 + F.month(at) * 100 + F.day(at)
    runs = data.table("orders").select(
        "o_custkey",
        "o_orderkey",
        packed_timestamp(packed, F.lit(0)).alias("run_at"),
        F.when(F.col("o_orderstatus") == "F", 0)
        .when(F.col("o_orderstatus") == "O", 1)
        .otherwise(4)
        .alias("status"),
        (F.col("o_orderkey") % 24 * 10000 + F.col("o_orderkey") % 60 * 100).alias("took"),
    )
    history = pl.run_history(
        data.table("customer"),
        runs,
        on=("c_custkey", "o_custkey"),
        name_col="c_name",
        name="Customer#000000605",
        run_at="run_at",
        step="o_orderkey",
        status="status",
        duration="took",
    )
    return history.select("o_orderkey", "run_at", "status_label", "duration_seconds")


# --- relations ------------------------------------------------------------------


def missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)

    def link(child: str, child_key: str, parent: str, parent_key: str) -> pl.Link:
        return pl.Link(
            f"{child}->{parent}",
            data.table(child), child_key, data.table(parent), parent_key,
        )

    return pl.missing_references(
        [
            link("orders", "o_custkey", "customer", "c_custkey"),
            link("lineitem", "l_orderkey", "orders", "o_orderkey"),
            link("lineitem", "l_partkey", "part", "p_partkey"),
            link("lineitem", "l_suppkey", "supplier", "s_suppkey"),
            link("nation", "n_regionkey", "region", "r_regionkey"),
            link("customer", "c_nationkey", "nation", "n_nationkey"),
            link("events", "user_id", "customer", "c_custkey"),
            link("orders", "o_orderkey", "lineitem", "l_orderkey"),
        ]
    )


def candidate_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that look like references, each checked against the key of that name."""
    data = _data(spark, sf_dir)
    tables = data.tables()
    single = {table: columns[0] for table, columns in KEYS.items() if len(columns) == 1}
    parents = {key.split("_", 1)[1]: (table, key) for table, key in single.items() if key[1] == "_"}
    found = pl.reference_candidates(tables, keys=single.items(), suffixes=["key"])
    links = []
    for table, column, _ in found:
        if column.split("_", 1)[1] in parents:
            parent, key = parents[column.split("_", 1)[1]]
            links.append(
                pl.Link(f"{table}.{column}", tables[table], column, tables[parent], key)
            )
    return pl.missing_references(links)


def unreferenced_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)
    return pl.unreferenced_rows(
        data.table("customer"), "c_custkey", data.table("events"), "user_id"
    ).select("c_custkey")


def unreferenced_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)
    return pl.unreferenced_rows(
        data.table("orders"), "o_orderkey", data.table("lineitem"), "l_orderkey"
    ).select("o_orderkey")


def find_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)
    return pl.find_references(
        data.table("documents"), "doc_id", "text",
        data.table("benchmark"), "item_id", "text",
    )


def find_short_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of one to four words: how benchmark passages begin."""
    data = _data(spark, sf_dir)
    words = (F.col("item_id") % 4 + 1).cast("int")
    start = F.array_join(F.slice(F.split("text", " "), F.lit(1), words), " ")
    items = data.table("benchmark").select("item_id", start.alias("text"))
    return pl.find_references(
        data.table("documents"), "doc_id", "text", items, "item_id", "text"
    )


def mention_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)
    return pl.mention_report(
        data.table("documents"), "doc_id", "text",
        data.table("benchmark"), "item_id", "text",
        max_lines=50,
    )


def grant_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)
    grants = pl.grant_listing(
        data.table("orders"),
        data.table("customer"),
        data.table("nation"),
        principal_on=("o_custkey", "c_custkey"),
        object_on=("c_nationkey", "n_nationkey"),
        exclude={"n_name": ["NATION_0"], "c_mktsegment": ["BUILDING"]},
        order_by=["n_name", "c_name", "o_orderkey"],
    )
    return grants.select("n_name", "c_name", "c_mktsegment", "o_orderkey", "o_orderstatus")


def annotate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)
    annotated = pl.annotate_rows(
        data.table("documents"),
        data.table("labels"),
        on=("doc_id", "doc_id"),
        filter="EN",
        filter_columns=["lang", "source"],
    )
    return annotated.select("doc_id", "quality", "toxic", "annotated")


def annotate_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the annotations of a JSON file that is made of their labels."""
    data = _data(spark, sf_dir)
    path = scratch_path(spark, "notes")
    entry = F.struct(
        F.col("doc_id").cast("string").alias("id"), F.lit("corpus").alias("database"),
        F.concat(F.lit("Document "), "doc_id").alias("objectName"), F.lit("label").alias("type"),
        F.concat(F.lit("quality "), "quality").alias("description"),
        F.lit("2024-01-01T00:00:00Z").alias("addedAt"),
    )
    lines = data.table("labels").select(
        F.to_json(F.struct(F.array(entry).alias("constraints"))).alias("value")
    )
    lines.write.text(path)
    notes = pl.read_annotations(spark, path, "document 1", lines=True).select(
        F.col("id").cast("bigint").alias("note_id"), "object_name", "description"
    )
    annotated = pl.annotate_rows(data.table("documents"), notes, on=("doc_id", "note_id"))
    return annotated.select("doc_id", "object_name", "description", "annotated")


def prefix_covered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered_days(spark, sf_dir, False).select(
        "user_id",
        F.col("covered").alias("covered_day"),
        F.col("covering").alias("covering_day"),
        "coverers",
    )


def prefix_covered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered_days(spark, sf_dir, True).select(
        "user_id",
        F.col("covered").alias("covered_day"),
        F.col("covering").alias("covering_day"),
    )


def _covered_days(spark: SparkSession, sf_dir: str, all_pairs: bool) -> DataFrame:
    events = _data(spark, sf_dir).table("events").withColumn("day", F.to_date("ts"))
    return pl.prefix_covered_lists(
        events, "user_id", "day", ["ts", "event_id"], "event_type", all_pairs=all_pairs
    )


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)
    return pl.latest_run(
        data.table("customer").select("c_custkey"),
        data.table("events"),
        on=("c_custkey", "user_id"),
        run_order=["ts", "event_id"],
        shown=["event_id", "ts", "event_type"],
    )


# --- profiles -------------------------------------------------------------------


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)
    return data.table("documents").join(data.table("labels"), "doc_id", "left")


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = pl.column_profile(
        _labelled(spark, sf_dir), ["quality", "text", "lang"],
        declared_lengths={"text": 40000, "lang": 8},
    )
    return profile


def nullable_without_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.nullable_without_nulls(_labelled(spark, sf_dir), candidates_only=False)


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _data(spark, sf_dir).table("part")
    return pl.duplicate_groups(part, ["p_name", "p_brand"], top=200)


def duplicate_line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = _data(spark, sf_dir).table("lineitem")
    return pl.duplicate_groups(lineitem, ["l_orderkey", "l_linenumber"], top=200)


def all_duplicate_line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = _data(spark, sf_dir).table("lineitem")
    return pl.duplicate_groups(lineitem, ["l_orderkey", "l_linenumber"], top=None)


def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _data(spark, sf_dir).table("documents")
    return pl.duplicate_groups(documents, ["text"], top=200)


def key_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)
    orders = data.table("orders")
    keys = [
        pl.KeyColumn("orders", orders, "o_orderkey"),
        pl.KeyColumn("orders_16000", orders, "o_orderkey", cap=16000),
        pl.KeyColumn("orders_20000", orders, "o_orderkey", cap=20000, seed=1),
    ]
    for table, columns in KEYS.items():
        if table != "orders":
            df = data.table(table)
            keys += [pl.KeyColumn(table, df, column) for column in columns]
    return pl.key_capacity(keys)


def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.dataset_summary(_data(spark, sf_dir).tables(), KEYS)


def check_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)
    lines = data.table("lineitem").join(
        data.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    tables = {
        "customer": data.table("customer"),
        "supplier": data.table("supplier"),
        "orders": data.table("orders"),
        "order_lines": lines,
    }
    rules = [
        pl.CheckRule("customer_balance", "customer", "c_acctbal >= 0"),
        pl.CheckRule("supplier_balance", "supplier", "s_acctbal >= 0"),
        pl.CheckRule("positive_price", "orders", "o_totalprice > 0"),
        pl.CheckRule("known_status", "orders", "o_orderstatus IN ('O', 'P')", enabled=False),
        pl.CheckRule("shipped_after_order", "order_lines", "l_shipdate >= o_orderdate"),
    ]
    return pl.check_rules(tables, rules).select(
        "rule", "table_name", "enabled", "checked", "violations", "trusted"
    )


def layout_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)
    tables = {name: data.table(name) for name in ("lineitem", "orders", "events")}
    return pl.layout_candidates(tables, suffixes=["id", "key"], names=["o_orderstatus", "l_linestatus"])


def approximate_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with fewer values than the sketches keep, so the estimates are exact."""
    data = _data(spark, sf_dir)
    tables = {name: data.table(name) for name in ("lineitem", "orders", "events")}
    names = ["l_linestatus", "l_returnflag", "l_linenumber", "o_orderstatus", "event_type"]
    return pl.layout_candidates(tables, suffixes=[], names=names, approx=True)


def table_schema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.table_schema_profile(_data(spark, sf_dir).table("orders"), ["o_orderkey"])


def customer_schema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.table_schema_profile(_data(spark, sf_dir).table("customer"), ["c_custkey"])


# --- activity -------------------------------------------------------------------


def role_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)
    return pl.role_lists(
        data.table("region"), "r_regionkey",
        data.table("nation"), "n_regionkey", "n_name",
    )


def member_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)
    return pl.member_roles(
        data.table("customer"), "c_custkey",
        data.table("orders"), "o_custkey", "o_orderpriority",
    )


def customer_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)
    return pl.role_lists(
        data.table("customer"), "c_custkey",
        data.table("orders"), "o_custkey", "o_orderpriority",
        exclude=[0],
    )


def event_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _data(spark, sf_dir).table("events").withColumn("day", F.to_date("ts"))
    labels = {
        "view": "VIEW", "click": "CLK", "signup": "SGN", "purchase": "BUY", "error": "ERR",
    }
    return pl.event_flags(events, ["user_id", "day"], "event_type", labels)


def activity_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)
    return pl.activity_rates(
        data.table("customer"), "c_custkey",
        data.table("events"), "user_id", "ts",
        reads=F.col("event_type").isin(*READ_TYPES),
        writes=F.col("event_type").isin(*WRITE_TYPES),
    )


def last_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)
    return pl.last_access(
        data.table("customer"), "c_custkey",
        data.table("events"), "user_id", "ts",
        reads=F.col("event_type").isin(*READ_TYPES),
        writes=F.col("event_type").isin(*WRITE_TYPES),
    )


def multi_event_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _data(spark, sf_dir).table("events").withColumn("day", F.to_date("ts"))
    return pl.multi_event_entities(events, "day", "user_id", "event_type")


def multi_event_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _data(spark, sf_dir).table("events").withColumn("day", F.to_date("ts"))
    groups = pl.multi_event_groups(events, "day", "user_id")
    return groups.withColumnRenamed("entities", "users")


def size_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _data(spark, sf_dir).table("documents")
    return pl.size_report(documents, "source", "text")


def size_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _data(spark, sf_dir).table("documents")
    return pl.size_report(documents, "lang", "text")


def top_by_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.top_by_cost(
        _data(spark, sf_dir).table("lineitem"),
        "l_partkey",
        cost=F.col("l_extendedprice").cast("decimal(18,2)"),
        measure=F.col("l_quantity").cast("decimal(18,2)"),
        run_at="l_shipdate",
        text=F.concat_ws("/", "l_returnflag", "l_linestatus"),
    )


def top_events_by_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.top_by_cost(
        _data(spark, sf_dir).table("events"),
        "event_type",
        cost=F.col("value").cast("decimal(18,2)"),
        measure=F.length("props"),
        run_at="ts",
        text=F.col("props"),
    )


def top_texts_by_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return pl.top_by_cost(
        _data(spark, sf_dir).table("conversations"),
        "role",
        cost=F.length(text),
        measure=F.octet_length(text),
        run_at="turn",
        text=text,
    )


def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _data(spark, sf_dir).table("events")
    value = F.col("value").cast("decimal(18,2)")
    return pl.share_of_total(events, "event_type", value, exclude=["error"])


def share_of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = _data(spark, sf_dir).table("lineitem")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return pl.share_of_total(lineitem, "l_suppkey", price)


def impact_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)
    prices = data.table("part").groupBy("p_partkey").agg(
        _mean("p_retailprice").alias("price")
    )
    lines = data.table("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        (_mean("l_discount") * 100).alias("discount"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.count_if(F.col("l_returnflag") == "A").alias("accepted"),
    )
    return pl.impact_ranking(
        prices, lines, "p_partkey", "price", "discount", "returned", "accepted"
    )


def _mean(column: str) -> Column:
    """Of values with two decimals, added exactly."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double") / F.count(column)


def clustering_fragmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _data(spark, sf_dir).table("orders")
    return pl.clustering_fragmentation(
        orders, "o_custkey", ["o_orderkey"], "o_orderdate", min_rows=10, high=50
    )


# --- comparison -----------------------------------------------------------------


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of the earlier orders against those of the later ones."""
    orders = _data(spark, sf_dir).table("orders")
    early = F.col("o_orderdate") < F.lit("1998-04-16").cast("timestamp_ntz")
    return pl.set_compare(
        orders.filter(early).select("o_custkey"),
        orders.filter(~early).select("o_custkey"),
        ["o_custkey"],
    )


def set_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _halves(spark, sf_dir)


def set_compare_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.set_compare_counts(_halves(spark, sf_dir))


def column_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _data(spark, sf_dir)

    def bare(df: DataFrame) -> DataFrame:
        return df.toDF(*[name[2:] for name in df.columns])

    return pl.column_diff(bare(data.table("customer")), bare(data.table("supplier")))


def text_version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _data(spark, sf_dir).table("conversations")
    return pl.text_version_diff(
        turns.filter(F.col("role") == "user"),
        turns.filter(F.col("role") == "assistant"),
        "conv_id",
        "text",
    )


def text_version_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _data(spark, sf_dir).table("conversations")
    return pl.text_version_tokens(
        turns.filter(F.col("role") == "user"),
        turns.filter(F.col("role") == "assistant"),
        "conv_id",
        "text",
    )


# --- feeds ----------------------------------------------------------------------


def _stamped(*parts: Column) -> Column:
    stamp = F.date_format("ts", "yyyyMMdd_HHmmss")
    return F.concat_ws("_", *parts, stamp).alias("name")


def _landing_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _data(spark, sf_dir).table("events")
    plain = spark.createDataFrame(
        [("view",), ("audit",), ("x_20241399_999999",)], "name string"
    )
    return events.select(_stamped(F.col("event_type"))).unionByName(plain)


def feed_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.feed_inventory(_landing_log(spark, sf_dir))


def feed_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.feed_orphans(_landing_log(spark, sf_dir))


def feed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.feed_totals(_landing_log(spark, sf_dir))


def feed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _data(spark, sf_dir).table("events")
    band = F.floor(F.col("value") / 40).cast("string")
    names = events.select(
        _stamped(F.col("user_id").cast("string"), F.col("event_type"), band)
    )
    latest = events.agg(F.max(F.date_trunc("SECOND", "ts"))).scalar().cast("timestamp_ntz")
    return pl.feed_health(names, as_of=latest)


def _drift(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users as feeds, days as snapshots, (event type, quarter day) as columns.

    The permanent table holds the columns of all days before the newest one.
    """
    events = _data(spark, sf_dir).table("events")
    quarter = F.floor(F.hour("ts") / 6).cast("string")
    columns = events.select(
        F.col("user_id").cast("string").alias("feed"),
        F.to_date("ts").alias("snapshot"),
        F.concat_ws("_", "event_type", quarter).alias("column"),
        F.floor(F.col("value") / 20).alias("band"),
    )
    newest = columns.groupBy("feed").agg(F.max("snapshot").alias("newest"))
    earlier = columns.join(newest, "feed").filter(F.col("snapshot") < F.col("newest"))

    def typed(df: DataFrame, *keys: str) -> DataFrame:
        kind = F.concat(F.lit("band"), F.max("band").cast("string"))
        return df.groupBy(*keys).agg(kind.alias("type"))

    return typed(columns, "feed", "snapshot", "column"), typed(earlier, "feed", "column")


def snapshot_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.snapshot_drift(*_drift(spark, sf_dir))


def snapshot_drift_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.snapshot_drift_columns(*_drift(spark, sf_dir))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: duplicated parts at the smallest scale."""
    return duplicate_groups(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {
        query.__name__: query
        for query in (
            table_inventory, inventory_from_footers, bounds_from_footers, lookup_in_sorted_files,
            column_name_lint, column_name_lint_counts, annotate_from_json, approximate_layout,
            object_listing, sample_rows, sample_texts, lookup_by_name,
            lookup_by_name_and_kind, lookup_page, search_text, external_references, keyword_guard,
            text_complexity, text_complexity_totals, page_complexity, name_lint, name_lint_counts,
            recent_changes, recent_failures, run_history, missing_references,
            candidate_references, find_short_references, prefix_covered_pairs,
            all_duplicate_line_keys, customer_schema_profile, member_roles, text_version_tokens,
            unreferenced_customers, unreferenced_orders, find_references,
            mention_report, grant_listing, annotate_rows, prefix_covered_lists,
            latest_run, column_profile, nullable_without_nulls, duplicate_groups,
            duplicate_line_keys, duplicate_texts, key_capacity, dataset_summary,
            check_rules, layout_candidates, table_schema_profile, role_lists,
            customer_priorities, event_flags, activity_rates, last_access,
            multi_event_entities, multi_event_groups, size_report, size_by_language, top_by_cost,
            top_events_by_cost,
            top_texts_by_cost, share_of_total, share_of_suppliers, impact_ranking,
            clustering_fragmentation, set_compare, set_compare_counts, column_diff,
            text_version_diff, feed_inventory, feed_orphans, feed_totals, feed_health,
            snapshot_drift, snapshot_drift_columns,
        )
    }
    if llm is None:
        return own
    return own | llm.queries() | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from oracle_queries import ORACLE

    if llm is None:
        return dict(ORACLE)
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return ORACLE | llm.oracle_sql() | pipeline
