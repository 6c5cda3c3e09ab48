"""Listing, sampling, search and lint over rows, names and texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import (
    clip_text,
    contains_ignoring_case,
    key_join,
    latest,
    limited,
    line_count,
    named_column,
    packed_seconds,
    require_columns,
    seconds_between,
    status_label,
)

# Fixed value: the suffix of a dated snapshot name, _YYYYMMDD_HHMMSS.
SNAPSHOT_SUFFIX = r"_[0-9]{8}_[0-9]{6}$"

# Words that mark a statement as writing.
WRITE_WORDS = (
    "INSERT", "UPDATE", "DELETE", "DROP", "TRUNCATE", "ALTER", "CREATE",
    "EXEC", "EXECUTE", "MERGE", "GRANT", "REVOKE", "DENY",
)

# Texts that mark a costly habit in a routine body.
ROUTINE_MARKERS = {
    "cursor": ("CURSOR",),
    "temp_table": (" #", "INTO #"),
    "dynamic_sql": ("EXEC(", "EXECUTE(", "SP_EXECUTESQL"),
    "nolock": ("NOLOCK",),
}
SERIOUS_MARKERS = ("cursor", "dynamic_sql")

# Name parts that repeat the type of a thing or its version.
TYPE_PREFIXES = ("tbl_", "sp_", "vw_", "col_", "f_", "fn_", "usp_")
VERSION_SUFFIXES = (
    "_v2", "_v3", "_v4", "_v5", "_final", "_old", "_backup", "_copy", "_new",
    "_temp", "_bak",
)


def is_snapshot(name: Column) -> Column:
    """Whether ``name`` ends in a dated snapshot suffix."""
    return name.rlike(SNAPSHOT_SUFFIX)


def without_snapshots(df: DataFrame, name_col: str) -> DataFrame:
    """Rows whose name is not a dated snapshot; a null name is kept."""
    return df.filter(~F.coalesce(is_snapshot(F.col(name_col)), F.lit(False)))


def table_inventory(
    tables: Mapping[str, DataFrame], name_filter: str | None = None
) -> DataFrame:
    """(table_name, row_count, column_count) per table, sorted by name.

    Counts read no column. All tables are counted in one aggregate; a seed row
    per table keeps empty tables in the list.
    """
    chosen = {
        name: df
        for name, df in tables.items()
        if name_filter is None or name_filter.lower() in name.lower()
    }
    session = next(iter(tables.values())).sparkSession
    marks = session.createDataFrame(
        [(name, len(df.columns), 0) for name, df in chosen.items()],
        "table_name string, column_count int, one int",
    )
    for name, df in chosen.items():
        marks = marks.unionByName(
            df.select(
                F.lit(name).alias("table_name"),
                F.lit(len(df.columns)).alias("column_count"),
                F.lit(1).alias("one"),
            )
        )
    return (
        marks.groupBy("table_name", "column_count")
        .agg(F.sum("one").alias("row_count"))
        .select("table_name", "row_count", "column_count")
        .orderBy("table_name")
    )


def object_listing(
    entities: Mapping[str, tuple[DataFrame, str]],
    type_filter: str | None = None,
    name_filter: str | None = None,
) -> DataFrame:
    """(object_type, name) of every entity, sorted by type then name.

    ``entities`` maps an object type to a frame and its name column. Other types
    than ``type_filter`` are not read at all; ``name_filter`` is a literal,
    case-insensitive substring.
    """
    chosen = {
        kind: source
        for kind, source in entities.items()
        if type_filter is None or kind.lower() == type_filter.lower()
    }
    if not chosen:
        raise ValueError(
            f"Unknown type '{type_filter}'. Available: {', '.join(entities)}"
        )
    listing = None
    for kind, (df, name_col) in chosen.items():
        part = df.select(
            F.lit(kind).alias("object_type"), F.col(name_col).alias("name")
        )
        listing = part if listing is None else listing.unionByName(part)
    if name_filter is not None:
        listing = listing.filter(contains_ignoring_case(F.col("name"), name_filter))
    return listing.orderBy("object_type", "name")


def sample_rows(
    df: DataFrame, order_by: Sequence[str], n: int | None = 5, max_width: int = 30
) -> DataFrame:
    """The first ``n`` rows (all with None) as text, long values cut with an ellipsis.

    A key is required so that the sample is repeatable. Each partition keeps only
    its own first n rows, and columns are turned into text after that.
    """
    order = require_columns(df, order_by)
    first = limited(df.orderBy(*[named_column(c) for c in order]), n)
    return first.select(
        *[
            F.coalesce(
                clip_text(named_column(c).cast("string"), max_width, max_width - 3),
                F.lit("NULL"),
            ).alias(c)
            for c in df.columns
        ]
    )


def lookup_by_name(
    df: DataFrame, key_col: str, name: object, kind_col: str | None = None, kind: object = None
) -> DataFrame:
    """The whole row called ``name``, of the given kind if one is given.

    The comparison is on the bare column, so it reaches the file scan.
    """
    found = df.filter(F.col(key_col) == F.lit(name))
    if kind is not None:
        found = found.filter(F.col(kind_col) == F.lit(kind))
    return found


def search_text(df: DataFrame, text_col: str, keyword: str) -> DataFrame:
    """Rows whose text contains the keyword: literal, any case, no shuffle."""
    return df.filter(contains_ignoring_case(F.col(text_col), keyword))


def external_references(
    df: DataFrame,
    id_col: str,
    text_col: str,
    pattern: str = r'href="([^"]+)"',
    target: str | None = None,
) -> DataFrame:
    """Distinct (id, target): what each text points at.

    ``pattern`` has one group, the target. A ``target`` argument keeps targets
    that contain it literally.
    """
    targets = F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(1))
    # A plain explode would also filter on the array's size, and so extract twice.
    found = df.select(
        F.col(id_col), F.explode_outer(F.array_distinct(targets)).alias("target")
    ).filter(F.col("target").isNotNull())
    if target is not None:
        found = found.filter(F.col("target").contains(target))
    return found.distinct()


def keyword_guard(
    df: DataFrame, text_col: str, words: Sequence[str] = WRITE_WORDS
) -> DataFrame:
    """Add ``first_word``, the first denied whole word in the text, and ``blocked``."""
    if not words:
        raise ValueError("No words given.")
    choice = "|".join(rf"\Q{word}\E" for word in words)
    match = F.regexp_extract(F.col(text_col), rf"(?i)\b({choice})\b", 1)
    guarded = df.withColumn("first_word", F.when(match != "", match))
    return guarded.withColumn("blocked", F.col("first_word").isNotNull())


def text_complexity(
    df: DataFrame,
    text_col: str,
    markers: Mapping[str, Sequence[str]] = ROUTINE_MARKERS,
    serious: Sequence[str] = SERIOUS_MARKERS,
    max_lines: int = 200,
) -> DataFrame:
    """Add ``lines``, one ``has_<group>`` flag per marker group, and ``review``.

    A text needs review if it has more than ``max_lines`` lines or a serious
    marker. Markers match literally in any case; missing text counts as empty.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    flagged = df.withColumn("lines", line_count(F.col(text_col)))
    for group, texts in markers.items():
        found = F.lit(False)
        for text in texts:
            found = found | contains_ignoring_case(body, text)
        flagged = flagged.withColumn(f"has_{group}", found)
    review = F.col("lines") > max_lines
    for group in serious:
        review = review | F.col(f"has_{group}")
    return flagged.withColumn("review", review)


def text_complexity_totals(complexity: DataFrame) -> DataFrame:
    """(total, flagged) over the result of :func:`text_complexity`."""
    return complexity.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("review").alias("flagged")
    )


def _name_rules(name: Column, columns: bool) -> dict[str, Column]:
    lower = F.lower(name)
    prefixed = F.lit(False)
    for prefix in TYPE_PREFIXES:
        prefixed = prefixed | lower.startswith(prefix)
    versioned = F.lit(False)
    for suffix in VERSION_SUFFIXES:
        versioned = versioned | lower.endswith(suffix)
    rules = {
        "type_prefix": prefixed,
        "all_caps": (name == F.upper(name)) & (F.length(name) > 1),
    }
    if columns:
        rules["underscore"] = name.contains("_")
    else:
        rules["version_suffix"] = versioned
        rules["underscore"] = name.contains("_") & ~prefixed
    return rules


def name_lint(names: DataFrame, name_col: str = "name", columns: bool = False) -> DataFrame:
    """(rule, name), one row per rule that a distinct name breaks.

    ``columns=True`` applies the rules for column names: no version rule, and an
    underscore counts even after a type prefix.
    """
    name = F.col("name")
    broken = F.array(
        *[
            F.when(breaks, F.lit(rule))
            for rule, breaks in _name_rules(name, columns).items()
        ]
    )
    distinct = names.select(F.col(name_col).alias("name")).distinct()
    return distinct.select(
        F.explode_outer(F.array_compact(broken)).alias("rule"), "name"
    ).filter(F.col("rule").isNotNull())


def name_lint_counts(
    names: DataFrame, name_col: str = "name", columns: bool = False
) -> DataFrame:
    """(rule, names): how many distinct names break each rule, zeros included."""
    distinct = names.select(F.col(name_col).alias("name")).distinct()
    rules = _name_rules(F.col("name"), columns)
    counted = distinct.agg(
        *[F.count_if(breaks).alias(rule) for rule, breaks in rules.items()]
    )
    return counted.unpivot([], list(rules), "rule", "names")


def recent_changes(
    df: DataFrame,
    created: str,
    modified: str,
    days: int = 30,
    as_of: datetime | Column | None = None,
) -> DataFrame:
    """Rows modified in the last ``days`` days, newest first, with ``is_new``.

    A row is new if it was modified less than two minutes after its creation.
    ``as_of`` defaults to the latest modification.
    """
    window = F.make_dt_interval(F.lit(int(days)))
    since = latest(df, F.col(modified), as_of) - window
    recent = df.filter(F.col(modified) >= since)
    age = seconds_between(F.col(created), F.col(modified))
    return recent.withColumn("is_new", age < 120).orderBy(F.desc(modified))


def recent_failures(
    entities: DataFrame,
    runs: DataFrame,
    on: tuple[str, str],
    failed: Column,
    run_at: str,
    days: int = 7,
    as_of: datetime | Column | None = None,
) -> DataFrame:
    """Failed runs of the last ``days`` days with their entity, newest first.

    ``on`` is (entity key, run key). The window starts at midnight, as run dates
    are whole days. ``as_of`` defaults to the latest run.
    """
    moment = latest(runs, F.col(run_at), as_of)
    since = F.date_trunc("DAY", moment).cast("timestamp_ntz") - F.expr(
        f"INTERVAL {days} DAYS"
    )
    failures = runs.filter(failed & (F.col(run_at) >= since))
    entity_key, run_key = on
    joined = key_join(failures, entities, run_key, entity_key)
    return joined.orderBy(F.desc(run_at))


def run_history(
    entities: DataFrame,
    runs: DataFrame,
    on: tuple[str, str],
    name_col: str,
    name: object,
    run_at: str,
    step: str,
    status: str | None = None,
    last_n: int | None = 20,
    duration: str | None = None,
) -> DataFrame:
    """The last ``last_n`` runs of one named entity, newest first, then by step.

    With ``status``, a column of status codes, ``status_label`` is added; with
    ``duration``, a column of packed HHMMSS digits, ``duration_seconds``. The run
    log is narrowed to the entity's key before the join, so only its runs move.
    """
    entity_key, run_key = on
    chosen = entities.filter(F.col(name_col) == F.lit(name))
    least = chosen.agg(F.min(entity_key)).scalar()
    greatest = chosen.agg(F.max(entity_key)).scalar()
    own_runs = runs.filter(F.col(run_key).between(least, greatest))
    joined = key_join(own_runs, chosen, run_key, entity_key)
    history = limited(joined.orderBy(F.desc(run_at), F.asc(step)), last_n)
    if status is not None:
        history = history.withColumn("status_label", status_label(F.col(status)))
    if duration is not None:
        history = history.withColumn("duration_seconds", packed_seconds(F.col(duration)))
    return history

