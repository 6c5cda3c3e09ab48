"""References between tables: missing, unused, nested, granted, latest."""

from __future__ import annotations

from collections.abc import Collection, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions import contains_ignoring_case, key_join, line_count
from plumbline.plans import containment_pairs, prefix_fingerprints


@dataclass(frozen=True)
class Link:
    """A child column that should hold keys of a parent column."""

    name: str
    child: DataFrame
    child_key: str
    parent: DataFrame
    parent_key: str


def reference_candidates(
    tables: Mapping[str, DataFrame],
    keys: Collection[tuple[str, str]] = (),
    declared: Collection[tuple[str, str]] = (),
    suffixes: Sequence[str] = ("id",),
) -> list[tuple[str, str, str]]:
    """(table, column, type) of columns that look like undeclared references.

    Integer and text columns whose name ends in one of ``suffixes``, in any case,
    except key columns and references already declared. Reads schemas only.
    """
    def lowered(pairs: Collection[tuple[str, str]]) -> set[tuple[str, str]]:
        return {(table.lower(), column.lower()) for table, column in pairs}

    skipped = lowered(keys) | lowered(declared)
    endings = tuple(suffix.lower() for suffix in suffixes)
    kinds = (T.ShortType, T.IntegerType, T.LongType, T.StringType)
    return sorted(
        (table, field.name, field.dataType.simpleString())
        for table, df in tables.items()
        for field in df.schema
        if isinstance(field.dataType, kinds)
        and field.name.lower().endswith(endings)
        and (table.lower(), field.name.lower()) not in skipped
    )


@dataclass(frozen=True)
class _KeyColumn:
    """A column that links compare, and its place among all of them."""

    table: DataFrame
    name: str
    place: int


#: Columns compared in one pass: as many as a 64-bit mask has bits, but the sign.
_COLUMNS_AT_ONCE = 63


def missing_references(links: Sequence[Link]) -> DataFrame:
    """(link, child_rows, child_keys, orphan_keys, coverage) per link.

    Null child keys are ignored. Coverage is the share of child keys that exist in the
    parent, 1 if there are none. Keys are compared as the type to which Spark brings both
    columns in a union.

    All links are checked together. Each table is read once, for all its columns; their
    values go into one aggregate per value that keeps which columns hold it and how often,
    so a hot key shrinks to one row per task before the only shuffle of keys, and no join
    is needed. More than ``_COLUMNS_AT_ONCE`` columns take a pass for every so many.
    """
    report = None
    for some in _passes(links):
        counted = _orphans(some)
        report = counted if report is None else report.unionByName(counted)
    known_share = (F.col("child_keys") - F.col("orphan_keys")) / F.col("child_keys")
    coverage = F.when(F.col("child_keys") > 0, known_share).otherwise(1.0)
    return report.withColumn("coverage", F.round(coverage, 4))


def _passes(links: Sequence[Link]) -> Iterator[list[Link]]:
    most = _COLUMNS_AT_ONCE // 2
    for start in range(0, len(links), most):
        yield list(links[start : start + most])


def _orphans(links: list[Link]) -> DataFrame:
    columns: list[_KeyColumn] = []
    tables: dict[int, DataFrame] = {}

    def place(table: DataFrame, name: str) -> int:
        # Two reads of a table have one hash; different tables practically never do.
        known = tables.setdefault(table.semanticHash(), table)
        if known is table or known.sameSemantics(table):
            table = known
        for column in columns:
            if column.table is table and column.name == name:
                return column.place
        columns.append(_KeyColumn(table, name, len(columns)))
        return len(columns) - 1

    ends = [(place(l.child, l.child_key), place(l.parent, l.parent_key)) for l in links]
    # Columns that links connect share their values; others must not meet.
    group = list(range(len(columns)))
    for child, parent in ends:
        group = [group[parent] if g == group[child] else g for g in group]
    kinds = {g: _common_type([c for c in columns if group[c.place] == g]) for g in set(group)}

    def value(column: _KeyColumn) -> Column:
        kind = kinds[group[column.place]]
        plain = F.col(column.name).cast(kind)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            plain = plain + F.lit(0.0).cast(kind)  # one zero
        return plain.cast("bigint" if isinstance(kind, T.IntegralType) else "string")

    def picked(own: list[_KeyColumn], whole: bool) -> Column:
        """The value of the column in place ``place``, if it is of this kind."""
        found = F.lit(None).cast("bigint" if whole else "string")
        for column in own:
            if isinstance(kinds[group[column.place]], T.IntegralType) == whole:
                found = F.when(F.col("place") == column.place, value(column)).otherwise(found)
        return found

    # Whole numbers are compared as such, everything else in its one spelling.
    sides = {"number": True, "text": False}
    used = [s for s, whole in sides.items()
            if any(isinstance(k, T.IntegralType) == whole for k in kinds.values())]
    values = None
    read = []
    for column in columns:
        if not any(t is column.table for t in read):
            read.append(column.table)
    for table in read:
        own = [c for c in columns if c.table is table]
        places = F.array(*[F.lit(c.place) for c in own])
        places = (F.explode(places) if len(own) > 1 else F.lit(own[0].place)).alias("place")
        of_group = F.get(F.array(*map(F.lit, group)), F.col("place"))
        some = table.select(*{c.name for c in own}, places).select(
            "place", of_group.alias("group"), *[picked(own, sides[s]).alias(s) for s in used]
        )
        values = some if values is None else values.unionByName(some)
    # A count for each child column of a group: groups share the counts' places.
    slot: dict[int, int] = {}
    for child in sorted({child for child, _ in ends}):
        slot[child] = sum(group[other] == group[child] for other in slot)
    slots = F.array(*[F.lit(slot.get(c.place, -1)) for c in columns])
    per_value = (
        values.filter(reduce(or_, [F.col(s).isNotNull() for s in used]))
        .withColumn("slot", F.get(slots, "place"))
        .groupBy("group", *used)
        .agg(
            F.bit_or(F.expr("shiftleft(1L, place)")).alias("held"),
            *[F.sum((F.col("slot") == n).cast("bigint")).alias(f"rows{n}")
              for n in sorted(set(slot.values()))],
        )
    )
    report = []
    for link, (child, parent) in zip(links, ends):
        rows, own = F.col(f"rows{slot[child]}"), F.col("group") == group[child]
        present = own & (rows > 0)
        known = F.col("held").bitwiseAND(F.lit(1 << parent)) != 0
        report.append(F.struct(
            F.lit(link.name).alias("link"),
            F.coalesce(F.sum(F.when(own, rows)), F.lit(0)).alias("child_rows"),
            F.count_if(present).alias("child_keys"),
            F.count_if(present & ~known).alias("orphan_keys"),
        ))
    return per_value.agg(F.array(*report).alias("links")).select(F.inline("links"))


def _common_type(columns: list[_KeyColumn]) -> T.DataType:
    """The type to which Spark brings the columns in a union."""
    kinds = [column.table.schema[column.name].dataType for column in columns]
    if all(kind == kinds[0] for kind in kinds):
        return kinds[0]
    frame = None
    for column in columns:
        own = column.table.select(F.col(column.name).alias("key"))
        frame = own if frame is None else frame.unionByName(own)
    return frame.schema["key"].dataType


def unreferenced_rows(
    entities: DataFrame, key: str, refs: DataFrame, ref_key: str
) -> DataFrame:
    """Entities no reference points to. Null references are ignored."""
    used = refs.select(F.col(ref_key).alias("_used")).filter(
        F.col("_used").isNotNull()
    )
    return entities.join(used.distinct(), F.col(key) == F.col("_used"), "left_anti")


def find_references(
    corpus: DataFrame,
    corpus_id: str,
    corpus_text: str,
    items: DataFrame,
    item_id: str,
    item_text: str,
    same_things: bool = False,
) -> DataFrame:
    """(item id, corpus id) for every text that contains the item, in any case.

    Ids name things: a pair of ids is reported once, however many rows have them, and
    a null id is an id. ``same_things=True`` says that items and
    texts are the same entities; an entity is then not reported in itself. If both
    id columns have one name, the item's is prefixed with ``item_``.
    """
    pairs = containment_pairs(
        corpus.select(
            F.col(corpus_id).alias("text_id"), F.col(corpus_text).alias("text")
        ),
        items.select(
            F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text")
        ),
    )
    if same_things:
        pairs = pairs.filter(~F.col("text_id").eqNullSafe(F.col("item_id")))
    return pairs.select(
        F.col("item_id").alias(_item_column(corpus_id, item_id)),
        F.col("text_id").alias(corpus_id),
    )


def _item_column(corpus_id: str, item_id: str) -> str:
    return f"item_{item_id}" if item_id == corpus_id else item_id


def mention_report(
    corpus: DataFrame,
    corpus_id: str,
    corpus_text: str,
    items: DataFrame,
    item_id: str,
    item_text: str,
    max_lines: int = 100,
    same_things: bool = False,
) -> DataFrame:
    """(corpus id, lines, items, is_complex) for every text.

    ``items`` is the sorted comma list of item ids the text contains, empty if
    none; it cannot outgrow the text's own content. A text is complex if it
    contains an item or has more than ``max_lines`` lines.
    """
    mentions = find_references(
        corpus, corpus_id, corpus_text, items, item_id, item_text, same_things
    )
    found_item = F.col(_item_column(corpus_id, item_id))
    lists = mentions.groupBy(F.col(corpus_id).alias("_text_id")).agg(
        F.array_join(
            F.sort_array(F.collect_set(found_item.cast("string"))), ", "
        ).alias("items")
    )
    texts = corpus.select(corpus_id, line_count(F.col(corpus_text)).alias("lines"))
    return texts.join(lists, F.col(corpus_id).eqNullSafe(F.col("_text_id")), "left").select(
        corpus_id,
        "lines",
        F.coalesce("items", F.lit("")).alias("items"),
        (F.col("items").isNotNull() | (F.col("lines") > max_lines)).alias("is_complex"),
    )


def grant_listing(
    facts: DataFrame,
    principals: DataFrame,
    objects: DataFrame,
    principal_on: tuple[str, str],
    object_on: tuple[str, str],
    exclude: Mapping[str, Sequence[object]],
    order_by: Sequence[str],
) -> DataFrame:
    """Facts joined to their actor and object, without the excluded values.

    ``principal_on`` and ``object_on`` are (left column, right column); the object
    may hang on the fact or on the principal. ``exclude`` maps a column to values
    whose rows are left out (null values too, as with NOT IN).
    """
    joined = key_join(facts, principals, *principal_on)
    joined = key_join(joined, objects, *object_on)
    for column, values in exclude.items():
        joined = joined.filter(~F.col(column).isin(list(values)))
    return joined.orderBy(*order_by)


def annotate_rows(
    df: DataFrame,
    annotations: DataFrame,
    on: tuple[str, str],
    filter: str | None = None,
    filter_columns: Sequence[str] = (),
) -> DataFrame:
    """All rows with their annotation, if any, and an ``annotated`` flag.

    ``filter`` keeps rows that contain it, in any case, in one of
    ``filter_columns``; it is applied before the join.
    """
    key, annotation_key = on
    if filter is not None:
        matches = F.lit(False)
        for column in filter_columns:
            matches = matches | contains_ignoring_case(F.col(column), filter)
        df = df.filter(matches)
    notes = annotations.withColumnRenamed(annotation_key, "_annotated_key")
    joined = df.join(notes, F.col(key) == F.col("_annotated_key"), "left")
    return joined.withColumn("annotated", F.col("_annotated_key").isNotNull()).drop(
        "_annotated_key"
    )


def prefix_covered_lists(
    items: DataFrame,
    group: str,
    list_id: str,
    order: Sequence[str],
    value: str,
    block: Column | None = None,
    all_pairs: bool = False,
    longest: int | None = None,
) -> DataFrame:
    """(group, covered, covering, coverers): lists that begin another, longer list.

    A list is the values of one (group, list_id) in the given order, which must
    be unique within it. Equal lists do not cover each other. Text values are
    compared in any case. Each covered list is one row: ``coverers`` is the number of
    lists that begin with it and ``covering`` the least of their ids. ``all_pairs=True``
    gives (group, covered, covering) for every pair instead, which grows with the square
    of the number of equal lists.

    Every element carries the fingerprint of the prefix that ends before it, so
    an equi-join on (group, length, fingerprint) gives the result and no list is
    ever gathered into a row. Lists are compared by 128-bit fingerprints alone: two
    different ones are taken as equal with a probability of 2**-128 per pair. Equal
    lists are one class while they are compared. Lists of more than ``longest`` elements
    are found and split into ranges of their order; ``block``, an expression that never
    decreases along the order, splits all lists instead, and raises where it does decrease.
    """
    content = F.col(value)
    if isinstance(items.schema[value].dataType, T.StringType):
        content = F.lower(content)
    keyed = items.withColumns({"_group": F.col(group), "_list": F.col(list_id)})
    prefixes, wholes = prefix_fingerprints(keyed, ["_group", "_list"], order, content, block, longest)
    print_ = ["_group", "length", "fp1", "fp2"]

    def same(left: str, right: str) -> Column:
        return reduce(
            and_, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in print_]
        )

    if all_pairs:
        found = prefixes.alias("p").join(wholes.alias("w"), same("p", "w"))
        return found.select(
            F.col("p._group").alias(group),
            F.col("w._list").alias("covered"),
            F.col("p._list").alias("covering"),
        )
    classes = wholes.groupBy(*print_).agg(
        F.min("_list").alias("least"), F.count(F.lit(1)).alias("lists")
    )
    firsts = classes.select(
        F.col("_group").alias("_class_group"), F.col("least").alias("_class_list"), "lists"
    )
    per_class = prefixes.join(
        firsts,
        F.col("_group").eqNullSafe(F.col("_class_group"))
        & F.col("_list").eqNullSafe(F.col("_class_list")),
    ).select(*print_, "_list", "lists")
    covers = per_class.groupBy(*print_).agg(
        F.min("_list").alias("covering"), F.sum("lists").alias("coverers")
    )
    return wholes.alias("w").join(covers.alias("c"), same("w", "c")).select(
        F.col("w._group").alias(group),
        F.col("w._list").alias("covered"),
        "covering",
        "coverers",
    )


def latest_run(
    entities: DataFrame,
    runs: DataFrame,
    on: tuple[str, str],
    run_order: Sequence[str],
    shown: Sequence[str],
) -> DataFrame:
    """Every entity with the ``shown`` columns of its most recent run.

    The latest run is the greatest ``run_order`` tuple, a null being least; of runs
    equal in it, the greatest ``shown`` tuple. The log is read once and reduced to one row
    per entity and task before its only shuffle. ``never_run`` marks entities without one.
    """
    entity_key, run_key = on
    newest = (
        runs.groupBy(F.col(run_key).alias("_run_key"))
        .agg(F.max(F.struct(F.struct(*run_order).alias("order"), F.struct(*shown).alias("run"))).alias("_last"))
        .select("_run_key", F.col("_last.run").alias("_run"))
    )
    joined = entities.join(newest, F.col(entity_key) == F.col("_run_key"), "left")
    return joined.select(
        *entities.columns,
        *[F.col(f"_run.{name}").alias(name) for name in shown],
        F.col("_run_key").isNull().alias("never_run"),
    )
