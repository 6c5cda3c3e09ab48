"""Activity, cost and size reports over logs and groups."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions import (
    clip_text,
    days_between,
    join_flags,
    latest,
    limited,
    size_label,
)
from plumbline.plans import out_of_order_counts


def _summable(df: DataFrame, measure: Column) -> Column:
    """The measure in a type whose sum is exact and can't run over, if there is one."""
    kind = df.select(measure.alias("_measure")).schema["_measure"].dataType
    return measure.cast("decimal(20,0)") if isinstance(kind, T.IntegralType) else measure


def member_roles(
    members: DataFrame,
    member: str,
    roles: DataFrame,
    role_member: str,
    role: str,
    exclude: Sequence[object] = (),
) -> DataFrame:
    """(member, role): a row for every distinct role of every member, null if it has none.

    Members in ``exclude`` are left out. No member's roles are gathered.
    """
    pairs = (
        roles.select(F.col(role_member).alias("_member"), F.col(role).alias("role"))
        .filter(F.col("role").isNotNull())
        .distinct()
    )
    kept = members.select(member)
    if exclude:
        kept = kept.filter(~F.col(member).isin(list(exclude)))
    return kept.join(pairs, F.col(member) == F.col("_member"), "left").select(member, "role")


def role_lists(
    members: DataFrame,
    member: str,
    roles: DataFrame,
    role_member: str,
    role: str,
    exclude: Sequence[object] = (),
    longest: int = 1000,
) -> DataFrame:
    """(member, roles): every member with its sorted role list, or ``(none)``.

    Members in ``exclude`` are left out. Repeated (member, role) rows are combined
    first, so a list is as long as the number of different roles. A member with more than
    ``longest`` of them has their number instead, as ``(n roles)``, so no list is
    gathered beyond that; :func:`member_roles` lists roles one by one.
    """
    pairs = (
        roles.select(F.col(role_member).alias("_member"), F.col(role).alias("_role"))
        .filter(F.col("_role").isNotNull())
        .distinct()
    )
    numbers = pairs.groupBy(F.col("_member").alias("_counted")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    counted = pairs.join(numbers, F.col("_member") == F.col("_counted"))
    some = F.when(F.col("_n") <= longest, F.col("_role"))
    lists = counted.groupBy("_member", "_n").agg(
        F.array_join(F.sort_array(F.collect_list(some)), ", ").alias("_names")
    ).select(
        "_member",
        F.when(F.col("_n") <= longest, F.col("_names"))
        .otherwise(F.concat(F.lit("("), "_n", F.lit(" roles)")))
        .alias("roles"),
    )
    kept = members.select(member)
    if exclude:
        kept = kept.filter(~F.col(member).isin(list(exclude)))
    return kept.join(lists, F.col(member) == F.col("_member"), "left").select(
        member, F.coalesce("roles", F.lit("(none)")).alias("roles")
    )


def event_flags(
    events: DataFrame, keys: Sequence[str], event_type: str, labels: dict[str, str]
) -> DataFrame:
    """One row per key with a 0/1 flag ``on_<type>`` per type and a joined label.

    ``labels`` maps each event type to its short label, in display order. Also
    accepts a streaming frame, written in complete mode.
    """
    flags = {
        kind: F.max(F.when(F.col(event_type) == kind, 1).otherwise(0))
        for kind in labels
    }
    flagged = events.groupBy(*keys).agg(
        *[flag.alias(f"on_{kind}") for kind, flag in flags.items()]
    )
    label = join_flags(
        ",", *[F.when(F.col(f"on_{kind}") == 1, text) for kind, text in labels.items()]
    )
    return flagged.withColumn("label", label)


def activity_rates(
    entities: DataFrame,
    entity: str,
    events: DataFrame,
    event_entity: str,
    event_time: str,
    reads: Column,
    writes: Column,
    as_of: datetime | Column | None = None,
) -> DataFrame:
    """(entity, reads, writes, reads_per_day, writes_per_day), most read first.

    ``reads`` and ``writes`` are conditions on an event. Rates divide by the days
    from the first event to ``as_of`` (the last event by default), at least one
    day. Only entities with a read or a write are listed. Events are counted per
    entity before the join, so a hot entity is one row there.
    """
    counted = events.groupBy(F.col(event_entity).alias("_entity")).agg(
        F.count_if(reads).alias("reads"), F.count_if(writes).alias("writes")
    )
    active = counted.filter(F.col("reads") + F.col("writes") > 0)
    start = events.agg(F.min(event_time)).scalar()
    days = F.greatest(
        days_between(start, latest(events, F.col(event_time), as_of)), F.lit(1.0)
    )
    return (
        entities.select(entity)
        .join(active, F.col(entity) == F.col("_entity"))
        .select(
            entity,
            "reads",
            "writes",
            F.round(F.col("reads") / days, 4).alias("reads_per_day"),
            F.round(F.col("writes") / days, 4).alias("writes_per_day"),
        )
        .orderBy(F.desc("reads"), entity)
    )


def last_access(
    entities: DataFrame,
    entity: str,
    events: DataFrame,
    event_entity: str,
    event_time: str,
    reads: Column,
    writes: Column,
) -> DataFrame:
    """(entity, last_read, last_write): never used first, then longest unused."""
    at = F.col(event_time)
    touched = events.groupBy(F.col(event_entity).alias("_entity")).agg(
        F.max(F.when(reads, at)).alias("last_read"),
        F.max(F.when(writes, at)).alias("last_write"),
    )
    return (
        entities.select(entity)
        .join(touched, F.col(entity) == F.col("_entity"), "left")
        .select(entity, "last_read", "last_write")
        .orderBy(F.asc_nulls_first(F.greatest("last_read", "last_write")), entity)
    )


def multi_event_entities(
    events: DataFrame, group: str, entity: str, event_type: str
) -> DataFrame:
    """(group, entity, types, label): entities with more than one event type.

    ``label`` joins the sorted types; there are as many as event types exist.
    """
    kinds = events.select(group, entity, event_type).distinct()
    found = kinds.groupBy(group, entity).agg(
        F.count(event_type).alias("types"),
        F.array_join(F.sort_array(F.collect_list(event_type)), ",").alias("label"),
    )
    return found.filter(F.col("types") > 1)


def multi_event_groups(events: DataFrame, group: str, entity: str) -> DataFrame:
    """(group, entities, entity): a row per entity of groups with more than one entity.

    ``entities`` is how many the group has. No group's names are gathered; a large group
    is as many rows as it has entities. Null entities are left out.
    """
    pairs = events.select(group, entity).filter(F.col(entity).isNotNull()).distinct()
    sizes = (
        pairs.groupBy(F.col(group).alias("_group"))
        .agg(F.count(F.lit(1)).alias("entities"))
        .filter(F.col("entities") > 1)
    )
    return pairs.join(sizes, F.col(group).eqNullSafe(F.col("_group"))).select(
        group, "entities", entity
    )


def size_report(df: DataFrame, group: str, text_col: str) -> DataFrame:
    """(group, rows, bytes, label, is_total), largest first, with a grand total.

    Rows are added up per group first; the total is rolled up from those sums. It
    is marked by ``is_total``, so a null group is not mistaken for it.
    """
    per_group = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.octet_length(text_col)).alias("bytes"),
    )
    return (
        per_group.rollup(group)
        .agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
            (F.grouping(group) == 1).alias("is_total"),
        )
        .withColumn("label", size_label(F.col("bytes")))
        .select(group, "rows", "bytes", "label", "is_total")
        .orderBy("is_total", F.desc("bytes"), group)
    )


def top_by_cost(
    log: DataFrame,
    key: str,
    cost: Column,
    measure: Column,
    run_at: str,
    text: Column,
    n: int | None = 20,
) -> DataFrame:
    """The ``n`` keys with the greatest total cost, all with None.

    (key, executions, total_cost, avg_cost, total_measure, avg_measure, last_run,
    preview). Costs and measures are added in their own type, integers and decimals
    exactly; pass them as decimals if they have fixed digits. ``preview`` is the text of
    the last run (the greatest, should several share its time), cut to 197
    characters and an ellipsis when longer than 200.

    The ranking shuffles numbers only. Previews are then read for the reported
    keys alone.
    """
    amount, second = _summable(log, cost), _summable(log, measure)
    per_key = log.groupBy(F.col(key).alias("_key")).agg(
        F.count(F.lit(1)).alias("executions"),
        F.sum(amount).alias("_cost"),
        F.sum(second).alias("_measure"),
        F.max(run_at).alias("last_run"),
    )
    worst = limited(per_key.orderBy(F.desc("_cost"), "_key"), n)
    last_texts = log.select(
        F.col(key).alias("_log_key"),
        F.col(run_at).alias("_at"),
        clip_text(F.trim(text), 200, 197).alias("_text"),
    )
    # All of the ranking's columns go through the second join, so that its shuffle
    # is the same as the first one's and is reused.
    same_run = F.col("_log_key").eqNullSafe(F.col("_key")) & F.col("_at").eqNullSafe(
        F.col("last_run")
    )
    shown = (
        last_texts.join(worst, same_run)
        .groupBy(*worst.columns)
        .agg(F.max("_text").alias("preview"))
    )

    def average(total: str) -> Column:
        return F.round(F.col(total).cast("double") / F.col("executions"), 4)

    return shown.orderBy(F.desc("_cost"), "_key").select(
        F.col("_key").alias(key),
        "executions",
        F.col("_cost").cast("double").alias("total_cost"),
        average("_cost").alias("avg_cost"),
        F.col("_measure").cast("double").alias("total_measure"),
        average("_measure").alias("avg_measure"),
        "last_run",
        F.coalesce("preview", F.lit("(unavailable)")).alias("preview"),
    )


def share_of_total(
    log: DataFrame,
    key: str,
    measure: Column,
    exclude: Sequence[object] = (),
    n: int | None = 20,
) -> DataFrame:
    """(key, total, events, pct_total) of the ``n`` largest keys, all with None.

    The measure is added in its own type, integers and decimals exactly.

    Excluded keys count neither in the list nor in the grand total. The percentage
    is null when the grand total is 0. The grand total is a scalar subquery over
    the per-key sums; a window over everything would move all rows to one task.
    """
    kept = log.filter(~F.col(key).isin(list(exclude))) if exclude else log
    per_key = kept.groupBy(key).agg(
        F.sum(_summable(log, measure)).alias("_sum"),
        F.count(F.lit(1)).alias("events"),
    )
    # Both sums are asked for so that the subquery needs the same columns as the
    # main query, and its shuffle is reused instead of reading the log twice.
    sums = F.struct(F.sum("_sum").cast("double").alias("total"), F.sum("events"))
    grand = per_key.agg(sums).scalar().getField("total")
    total = F.col("_sum").cast("double")
    return (
        limited(per_key.orderBy(F.desc("_sum"), key), n)
        .select(
            key,
            total.alias("total"),
            "events",
            F.round(F.try_divide(total * 100, grand), 2).alias("pct_total"),
        )
    )


def impact_ranking(
    costs: DataFrame,
    benefits: DataFrame,
    key: str,
    cost: str,
    benefit: str,
    hit_a: str,
    hit_b: str,
    hits: DataFrame | None = None,
) -> DataFrame:
    """(key, hits, score), highest score first.

    The score is cost * benefit * (hits a + hits b) as a double, rounded once to a whole
    number. All inputs hold one row per key; a key missing from one is not ranked. Hits
    are columns of ``benefits`` unless a frame of their own is given; one frame for both
    is computed once.
    """
    joined = costs.select(key, cost)
    if hits is None:
        joined = joined.join(benefits.select(key, benefit, hit_a, hit_b), key)
    else:
        joined = joined.join(benefits.select(key, benefit), key)
        joined = joined.join(hits.select(key, hit_a, hit_b), key)
    total = F.col(hit_a) + F.col(hit_b)
    score = F.col(cost).cast("double") * F.col(benefit).cast("double") * total.cast("double")
    return joined.select(
        key, total.alias("hits"), F.round(score, 0).alias("score")
    ).orderBy(F.desc("score"), key)


def clustering_fragmentation(
    df: DataFrame,
    group: str,
    order: Sequence[str],
    value: str,
    min_rows: int,
    high: float = 30,
    low: float = 10,
    block: Column | None = None,
    longest: int | None = None,
) -> DataFrame:
    """(group, rows, pct, action): how far a value is out of order, worst first.

    ``pct`` is the percentage of rows whose value is below the one before them in
    the given order. Groups of at least ``min_rows`` rows with more than ``low``
    percent are listed: REBUILD from ``high``, else REORGANIZE. Groups of more than
    ``longest`` rows are found and split into ranges of their order; ``block``, an
    expression that never decreases along the order, splits all groups instead, and raises
    where it does decrease.
    """
    counts = out_of_order_counts(
        df.withColumn("_group", F.col(group)), ["_group"], order, value, block, longest
    )
    share = F.col("out_of_order") * 100.0 / F.col("rows")
    pct = F.round(share, 1)
    return (
        counts.filter((F.col("rows") >= min_rows) & (share > low))
        .select(
            F.col("_group").alias(group),
            "rows",
            pct.alias("pct"),
            F.when(pct >= high, "REBUILD").otherwise("REORGANIZE").alias("action"),
        )
        .orderBy(F.desc("pct"), group)
    )
