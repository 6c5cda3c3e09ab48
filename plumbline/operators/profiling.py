"""Column, key and table profiles, duplicates and rule checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plumbline.functions import clip_text, limited, named_column, require_columns
from plumbline.plans import column_counts, digest_key, is_digest

# The largest value of each integer type.
TYPE_LIMITS = {
    "tinyint": 127,
    "smallint": 32767,
    "int": 2147483647,
    "bigint": 9223372036854775807,
}

# Column names that are common filters.
FILTER_NAMES = (
    "IsActive", "IsDeleted", "Status", "CreatedAt", "DeletedAt", "TenantId",
    "OrganisationId", "OrganizationId", "AccountId",
)


def _is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.CharType, T.VarcharType))


def column_profile(
    df: DataFrame,
    columns: str | Sequence[str],
    approx: bool = False,
    text_order: bool = False,
    declared_lengths: Mapping[str, int] | None = None,
) -> DataFrame:
    """One row of measures per column.

    Null percent is 0 for an empty table. Minimum and maximum follow the column's
    own order and are shown as text; ``text_order=True`` compares them as text.
    Text lengths ignore trailing blanks. ``oversized`` marks a column declared
    (``declared_lengths``, or a char/varchar type) more than twice as wide as its
    longest value.

    Plain measures come from one aggregate without grouping. Distinct values are
    counted separately, by value or digest, so long texts are not shuffled;
    ``approx=True`` skips that shuffle.
    """
    wanted = [columns] if isinstance(columns, str) else columns
    names = require_columns(df, wanted)
    declared = dict(declared_lengths or {})
    measures, rows = [], []
    for i, name in enumerate(names):
        data_type = df.schema[name].dataType
        column = named_column(name)
        ordered = column.cast("string") if text_order else column
        length = F.length(F.rtrim(column)) if _is_text(data_type) else F.lit(None)
        if isinstance(data_type, (T.CharType, T.VarcharType)):
            declared.setdefault(name, data_type.length)
        measures += [
            F.count(F.lit(1)).alias(f"total{i}"),
            F.count(column).alias(f"non_null{i}"),
            F.min(ordered).cast("string").alias(f"min{i}"),
            F.max(ordered).cast("string").alias(f"max{i}"),
            F.max(length).cast("int").alias(f"max_len{i}"),
            F.round(F.avg(length.cast("double")), 1).alias(f"avg_len{i}"),
        ]
        if approx:
            measures.append(F.approx_count_distinct(column).alias(f"distinct{i}"))
        width = declared.get(name)
        oversized = (
            F.coalesce(F.col(f"max_len{i}") < width // 2, F.lit(False))
            if width is not None
            else F.lit(False)
        )
        rows.append(
            F.struct(
                F.lit(name).alias("column"),
                F.col(f"total{i}").alias("total"),
                F.col(f"non_null{i}").alias("non_null"),
                F.col(f"min{i}").alias("min_value"),
                F.col(f"max{i}").alias("max_value"),
                F.col(f"max_len{i}").alias("max_len"),
                F.col(f"avg_len{i}").alias("avg_len"),
                oversized.alias("oversized"),
                (F.col(f"distinct{i}") if approx else F.lit(0)).cast("long").alias(
                    "approx_distinct"
                ),
            )
        )
    stats = df.agg(*measures).select(F.inline(F.array(*rows)))
    nulls = F.col("total") - F.col("non_null")
    share = (nulls * 100).cast("decimal(25,0)") / F.col("total")
    stats = stats.withColumns(
        {
            "nulls": nulls,
            "null_pct": F.when(F.col("total") == 0, 0.0).otherwise(
                F.bround(share, 1).cast("double")
            ),
        }
    )
    if approx:
        stats = stats.withColumnRenamed("approx_distinct", "distinct_count")
    else:
        exact = column_counts(df, names).select("column", "distinct_count")
        stats = stats.join(exact, "column")
    return stats.select(
        "column", "total", "non_null", "nulls", "null_pct", "distinct_count",
        "min_value", "max_value", "max_len", "avg_len", "oversized",
    )


def nullable_without_nulls(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    candidates_only: bool = True,
) -> DataFrame:
    """(column, has_nulls) of nullable columns, by default those without a null.

    One scan for all columns. Files always read as nullable, so every column is
    checked unless a list is given. A frame without nullable columns gives no row.
    """
    if columns is None:
        names = [field.name for field in df.schema if field.nullable]
    else:
        names = require_columns(df, columns)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, has_nulls boolean")
    flags = df.agg(
        *[
            F.coalesce(F.bool_or(named_column(name).isNull()), F.lit(False)).alias(name)
            for name in names
        ]
    )
    checked = flags.unpivot(
        [], [named_column(name) for name in names], "column", "has_nulls"
    )
    return checked.filter(~F.col("has_nulls")) if candidates_only else checked


def duplicate_groups(
    df: DataFrame, columns: Sequence[str], top: int | None = 20, max_width: int | None = None
) -> DataFrame:
    """Key groups with more than one row, most duplicated first.

    ``top`` groups are given, or all with None. Ties go by key, ascending. A null key is
    a group. ``max_width`` cuts long text keys in the result.

    Long texts are counted by digest, so the shuffle moves short keys. Groups whose count
    reaches that of the last one asked for are ranked by their texts, which a second
    scan fetches; adaptive execution drops it when no such key is a digest.
    """
    names = require_columns(df, columns)
    if top is not None and top < 1:
        raise ValueError("top must be at least 1.")
    texts = [name for name in names if _is_text(df.schema[name].dataType)]
    keys = [f"_k{i}" for i in range(len(names))]
    keyed = df.select(
        *[
            (digest_key(named_column(n)) if n in texts else named_column(n)).alias(key)
            for key, n in zip(keys, names)
        ],
        *[named_column(n).alias(f"_v{i}") for i, n in enumerate(names)],
    )
    digested = F.lit(False)
    for key, name in zip(keys, names):
        if name in texts:
            digested = digested | F.coalesce(is_digest(F.col(key)), F.lit(False))
    # Worked out in the aggregate, which short and long keys then share.
    counted = keyed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("duplicate_count"), F.bool_or(digested).alias("_digested")
    )
    worst = counted.filter(F.col("duplicate_count") > 1)
    if not texts:
        return limited(worst.orderBy(F.desc("duplicate_count"), *keys), top).select(
            *[F.col(key).alias(name) for key, name in zip(keys, names)],
            "duplicate_count",
        )

    if top is not None:
        best = worst.select("duplicate_count").orderBy(F.desc("duplicate_count")).limit(top)
        worst = worst.filter(
            F.col("duplicate_count") >= best.agg(F.min("duplicate_count")).scalar()
        )
    short = worst.filter(~F.col("_digested")).select(
        *keys, "duplicate_count", *[F.col(k).alias(f"_v{i}") for i, k in enumerate(keys)]
    )
    wanted = worst.filter("_digested").select(
        *[F.col(k).alias(f"_w{k}") for k in keys], "duplicate_count"
    )
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_w{key}"))
    long = keyed.join(wanted, same).groupBy(*keys, "duplicate_count").agg(
        *[F.any_value(f"_v{i}").alias(f"_v{i}") for i in range(len(names))]
    )
    values = [f"_v{i}" for i in range(len(names))]
    ranked = limited(
        short.unionByName(long).orderBy(F.desc("duplicate_count"), *values), top
    )
    shown = [
        clip_text(F.col(value), max_width, max_width - 3)
        if max_width is not None and name in texts
        else F.col(value)
        for value, name in zip(values, names)
    ]
    return ranked.select(
        *[value.alias(name) for value, name in zip(shown, names)], "duplicate_count"
    )


@dataclass(frozen=True)
class KeyColumn:
    """An integer key; ``cap`` and ``seed`` default to its type and its minimum."""

    table: str
    df: DataFrame
    column: str
    cap: int | None = None
    seed: int | None = None


def key_capacity(keys: Sequence[KeyColumn]) -> DataFrame:
    """How far each integer key has used up its range.

    ``used_pct`` is (last - seed + 1) * 100 / (cap - seed + 1), rounded half-even
    to one decimal, 0 for an empty column; flagged WARNING from 70 and CRITICAL
    from 90. Each frame is scanned once for all of its keys. An unsigned server type
    that Spark reads as a wider one needs its own ``cap``, such as 255.
    """
    frames: dict[int, list[KeyColumn]] = {}
    for key in keys:
        frames.setdefault(id(key.df), []).append(key)
    report = None
    for group in frames.values():
        bounds, rows = [], []
        for i, key in enumerate(group):
            name = require_columns(group[0].df, [key.column])[0]
            limit = key.cap
            if limit is None:
                kind = key.df.schema[name].dataType.simpleString()
                if kind not in TYPE_LIMITS:
                    raise ValueError(f"Column '{name}' is {kind}, not an integer.")
                limit = TYPE_LIMITS[kind]
            bounds += [
                F.min(named_column(name)).cast("long").alias(f"min{i}"),
                F.max(named_column(name)).cast("long").alias(f"max{i}"),
            ]
            seed = F.lit(key.seed) if key.seed is not None else F.col(f"min{i}")
            rows.append(
                F.struct(
                    F.lit(key.table).alias("table_name"),
                    F.lit(name).alias("column"),
                    F.col(f"min{i}").alias("min_value"),
                    F.col(f"max{i}").alias("max_value"),
                    F.lit(limit).cast("long").alias("cap"),
                    seed.cast("decimal(20,0)").alias("seed"),
                )
            )
        part = group[0].df.agg(*bounds).select(F.inline(F.array(*rows)))
        report = part if report is None else report.unionByName(part)
    used = (
        (F.col("max_value").cast("decimal(20,0)") - F.col("seed") + 1)
        * 100
        / (F.col("cap").cast("decimal(20,0)") - F.col("seed") + 1)
    )
    known = F.col("max_value").isNotNull() & (F.col("cap") > 0)
    report = report.withColumn(
        "used_pct",
        F.when(known, F.bround(used, 1).cast("double")).otherwise(0.0),
    )
    flag = (
        F.when(F.col("used_pct") >= 90, "CRITICAL")
        .when(F.col("used_pct") >= 70, "WARNING")
        .otherwise("")
    )
    return report.drop("seed").withColumn("flag", flag)


def dataset_summary(
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, Sequence[str]],
    top: int = 10,
) -> DataFrame:
    """(metric, value) rows that describe a set of tables.

    Metrics: ``table_count``, ``total_rows``, ``tables_without_unique_key``,
    ``tables_with_null_keys`` and ``rows:<table>`` for the ``top`` largest tables.
    A table has no unique key if ``keys`` names none for it, or if the named one
    holds duplicates or nulls. Keys are counted per value, so a repeated key is
    combined before the shuffle.
    """
    facts = None
    for name, df in tables.items():
        if keys.get(name):
            key = require_columns(df, keys[name])
            missing = F.lit(False)
            for column in key:
                missing = missing | named_column(column).isNull()
            per_key = df.groupBy(*[named_column(c) for c in key]).agg(
                F.count(F.lit(1)).alias("n")
            )
            fact = per_key.agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                F.coalesce(F.bool_or(F.col("n") > 1), F.lit(False)).alias("repeated"),
                F.coalesce(F.bool_or(missing), F.lit(False)).alias("null_key"),
            )
        else:
            fact = df.agg(
                F.count(F.lit(1)).alias("rows"),
                F.lit(True).alias("repeated"),
                F.lit(False).alias("null_key"),
            )
        fact = fact.withColumn("table_name", F.lit(name))
        facts = fact if facts is None else facts.unionByName(fact)

    def entry(metric: Column, value: Column, listed: bool = False) -> Column:
        return F.struct(
            metric.alias("metric"),
            value.cast("long").alias("value"),
            F.lit(listed).alias("listed"),
        )

    keyless = F.col("repeated") | F.col("null_key")
    entries = facts.select(
        F.inline(
            F.array(
                entry(F.lit("table_count"), F.lit(1)),
                entry(F.lit("total_rows"), F.col("rows")),
                entry(F.lit("tables_without_unique_key"), keyless),
                entry(F.lit("tables_with_null_keys"), F.col("null_key")),
                entry(F.concat(F.lit("rows:"), "table_name"), F.col("rows"), True),
            )
        )
    )
    # From here on there are five rows per table, however large the tables are.
    summed = entries.groupBy("metric", "listed").agg(F.sum("value").alias("value"))
    ranked = summed.withColumn(
        "rank",
        F.row_number().over(
            Window.partitionBy("listed").orderBy(F.desc("value"), "metric")
        ),
    )
    return ranked.filter(~F.col("listed") | (F.col("rank") <= top)).select(
        "metric", "value"
    )


@dataclass(frozen=True)
class CheckRule:
    """A predicate that every row of a table should satisfy."""

    name: str
    table: str
    predicate: str
    enabled: bool = True


def check_rules(tables: Mapping[str, DataFrame], rules: Sequence[CheckRule]) -> DataFrame:
    """(rule, table_name, predicate, enabled, checked, violations, trusted).

    A row violates a rule only where the predicate is false; an unknown result
    passes. Disabled rules are listed with no counts and are never trusted. Every
    table is scanned once for all of its rules.
    """
    by_table: dict[str, list[CheckRule]] = {}
    for rule in rules:
        if rule.table not in tables:
            raise ValueError(
                f"Unknown table '{rule.table}'. Available: {', '.join(tables)}"
            )
        by_table.setdefault(rule.table, []).append(rule)
    report = None
    for table, group in by_table.items():
        measures = [F.count(F.lit(1)).alias("checked")]
        rows = []
        for i, rule in enumerate(group):
            if rule.enabled:
                measures.append(F.count_if(~F.expr(rule.predicate)).alias(f"bad{i}"))
            rows.append(
                F.struct(
                    F.lit(rule.name).alias("rule"),
                    F.lit(table).alias("table_name"),
                    F.lit(rule.predicate).alias("predicate"),
                    F.lit(rule.enabled).alias("enabled"),
                    (F.col("checked") if rule.enabled else F.lit(None))
                    .cast("long").alias("checked"),
                    (F.col(f"bad{i}") if rule.enabled else F.lit(None))
                    .cast("long").alias("violations"),
                )
            )
        part = tables[table].agg(*measures).select(F.inline(F.array(*rows)))
        report = part if report is None else report.unionByName(part)
    return report.withColumn(
        "trusted", F.col("enabled") & F.coalesce(F.col("violations") == 0, F.lit(False))
    )


def layout_candidates(
    tables: Mapping[str, DataFrame],
    suffixes: Sequence[str] = ("id",),
    names: Sequence[str] = FILTER_NAMES,
    laid_out: Sequence[tuple[str, str]] = (),
    approx: bool = False,
) -> DataFrame:
    """(table_name, column, ndv, ndv_ratio, top_share) of likely layout columns.

    Candidates are columns whose name ends in one of ``suffixes`` or is one of
    ``names``, in any case, except (table, column) pairs already ``laid_out``. A
    high ratio suits bucketing, few values suit partitioning, and a high share of
    the most frequent value warns of skew. ``approx=True`` estimates ndv and
    top_share in one pass without a shuffle of values.
    """
    endings = tuple(suffix.lower() for suffix in suffixes)
    exact = {name.lower() for name in names}
    done = {(table.lower(), column.lower()) for table, column in laid_out}
    report = None
    for table, df in tables.items():
        columns = [
            c for c in df.columns
            if (c.lower().endswith(endings) or c.lower() in exact)
            and (table.lower(), c.lower()) not in done
        ]
        if not columns:
            continue
        part = column_counts(df, columns, approx).select(
            F.lit(table).alias("table_name"), "*"
        )
        report = part if report is None else report.unionByName(part)
    if report is None:
        raise ValueError("No column looks like a key or a common filter.")
    total = F.nullif(F.col("total"), F.lit(0))
    return report.select(
        "table_name",
        "column",
        F.col("distinct_count").alias("ndv"),
        F.round(F.coalesce(F.col("distinct_count") / total, F.lit(0.0)), 4).alias(
            "ndv_ratio"
        ),
        F.round(
            F.when(F.col("total") == 0, 0.0).otherwise(F.col("top_count") / total), 4
        ).alias("top_share"),
    )


def table_schema_profile(
    df: DataFrame, key: Sequence[str] = (), approx: bool = False
) -> DataFrame:
    """One row per column, in order: type, nullability and measured contents.

    (ordinal, column, type, nullable, nulls, distinct_count, is_unique, is_key). With
    ``approx=True`` distinct counts are estimated, and is_unique with them.
    """
    keys = {name.lower() for name in (require_columns(df, key) if key else [])}
    declared = df.sparkSession.createDataFrame(
        [
            (i, f.name, f.dataType.simpleString(), f.nullable, f.name.lower() in keys)
            for i, f in enumerate(df.schema, start=1)
        ],
        "ordinal int, column string, type string, nullable boolean, is_key boolean",
    )
    measured = column_counts(df, df.columns, approx)
    return declared.join(measured, "column").select(
        "ordinal", "column", "type", "nullable", "nulls", "distinct_count",
        (
            (F.col("nulls") == 0) & (F.col("distinct_count") == F.col("total"))
        ).alias("is_unique"),
        "is_key",
    ).orderBy("ordinal")
