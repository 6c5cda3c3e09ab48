"""Landed feeds: dated snapshots named ``Base_YYYYMMDD_HHMMSS``.

A name that ends in the suffix is a snapshot of the feed ``Base``; any other name
is a current object. Feed names match in any case. Names may repeat in a landing
log; every name counts once.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions import join_flags, seconds_between
from plumbline.operators.rows import is_snapshot

# Limits of a healthy feed.
OVERDUE_SECONDS = 24 * 3600
CLEANUP_SECONDS = 5 * 24 * 3600
MAX_SNAPSHOTS = 6

_SUFFIX_LENGTH = 16


def snapshot_time(name: Column) -> Column:
    """The moment in a snapshot name; null if it is no valid date and time."""
    digits = F.regexp_replace(F.right(name, F.lit(_SUFFIX_LENGTH - 1)), "_", "")
    return F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def _classified(names: DataFrame, name_col: str) -> DataFrame:
    """Distinct names with the base they belong to and whether they are snapshots."""
    distinct = names.select(F.col(name_col).alias("name")).filter(
        F.col("name").isNotNull()
    ).distinct()
    base = F.left("name", F.length("name") - _SUFFIX_LENGTH)
    return distinct.withColumn("is_snapshot", is_snapshot(F.col("name"))).select(
        "name",
        "is_snapshot",
        F.when(F.col("is_snapshot"), base).otherwise(F.col("name")).alias("base"),
        F.when(F.col("is_snapshot"), snapshot_time(F.col("name"))).alias("taken"),
    )


def _per_feed(names: DataFrame, name_col: str) -> DataFrame:
    """One row per base, in any case, with its snapshot and current counts.

    Names are first counted per exact base, which hashes, so that only one row per
    spelling takes part in choosing the smallest spelling.
    """
    snapshot = F.col("is_snapshot")
    per_base = _classified(names, name_col).groupBy("base").agg(
        F.count_if(snapshot).alias("snapshots"),
        F.count_if(~snapshot).alias("current"),
        F.max("taken").alias("latest"),
        F.min("taken").alias("earliest"),
    )
    return per_base.groupBy(F.lower("base").alias("_feed")).agg(
        F.min(F.when(F.col("snapshots") > 0, F.col("base"))).alias("feed"),
        F.sum("snapshots").alias("snapshots"),
        F.sum("current").alias("current"),
        F.max("latest").alias("latest"),
        F.min("earliest").alias("earliest"),
    )


def feed_inventory(names: DataFrame, name_col: str = "name") -> DataFrame:
    """(feed, snapshots, latest, earliest, has_current) per feed, sorted by name.

    ``feed`` is the smallest spelling of the base. A suffix that is no valid date
    counts as a snapshot but gives no date. ``has_current`` tells whether an
    object named exactly like the base exists. Snapshots and current names meet in
    one aggregate on the base; no join is needed.
    """
    feeds = _per_feed(names, name_col).filter(F.col("snapshots") > 0)
    return feeds.orderBy("_feed").select(
        "feed",
        "snapshots",
        "latest",
        "earliest",
        (F.col("current") > 0).alias("has_current"),
    )


def feed_orphans(names: DataFrame, name_col: str = "name") -> DataFrame:
    """(name): current objects that belong to no feed."""
    classified = _classified(names, name_col)
    feeds = (
        classified.filter("is_snapshot")
        .select(F.lower("base").alias("_feed"))
        .distinct()
    )
    current = classified.filter(~F.col("is_snapshot"))
    return current.join(feeds, F.lower("name") == F.col("_feed"), "left_anti").select(
        "name"
    )


def feed_totals(names: DataFrame, name_col: str = "name") -> DataFrame:
    """(feeds, snapshots, orphans): the counts under the feed listing."""
    has_feed = F.col("snapshots") > 0
    orphans = F.sum(F.when(~has_feed, F.col("current")).otherwise(0))
    return _per_feed(names, name_col).agg(
        F.count_if(has_feed).alias("feeds"),
        F.coalesce(F.sum("snapshots"), F.lit(0)).alias("snapshots"),
        F.coalesce(orphans, F.lit(0)).alias("orphans"),
    )


def feed_health(
    names: DataFrame, as_of: datetime | Column | None = None, name_col: str = "name"
) -> DataFrame:
    """(feed, snapshots, latest, flags) of unhealthy feeds, worst first.

    OVERDUE: the latest snapshot is more than 24 hours old. CLEANUP LATE: the
    earliest is more than 5 days old. EXCESS: more than 6 snapshots. ``as_of``
    defaults to the current time, so feeds that have all stopped are overdue.
    """
    feeds = _per_feed(names, name_col).filter(F.col("snapshots") > 0)
    if as_of is None:
        moment = F.localtimestamp()
    elif isinstance(as_of, Column):
        moment = as_of
    else:
        moment = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")

    def older_than(taken: str, seconds: int) -> Column:
        return seconds_between(F.col(taken), moment) > seconds

    flags = [
        F.when(older_than("latest", OVERDUE_SECONDS), "OVERDUE"),
        F.when(older_than("earliest", CLEANUP_SECONDS), "CLEANUP LATE"),
        F.when(F.col("snapshots") > MAX_SNAPSHOTS, "EXCESS"),
    ]
    raised = F.size(F.array_compact(F.array(*flags)))
    return (
        feeds.withColumn("flags", join_flags(", ", *flags))
        .withColumn("_raised", raised)
        .filter(F.col("_raised") > 0)
        .orderBy(F.desc("_raised"), F.lower("feed"))
        .select("feed", "snapshots", "latest", "flags")
    )


def snapshot_drift_columns(snapshots: DataFrame, permanent: DataFrame) -> DataFrame:
    """(feed, column, newest_type, permanent_type, status) per feed and column.

    ``snapshots`` has (feed, snapshot, column, type), ``permanent`` has (feed,
    column, type). Only each feed's newest snapshot counts: the greatest one, with
    null (no valid date) last. Status is only_newest (dropped by the load),
    only_permanent (added by it), mismatch or identical; feed, column and type
    match in any case. Feeds on one side only are listed too.

    Snapshots are first reduced to the last one of each (feed, column, type), which
    shrinks a feed with many snapshots before any shuffle; a column is in the newest
    snapshot if its last one is. Both sides then meet in another aggregate.
    """
    feed = F.lower("feed")
    per_type = snapshots.groupBy("feed", "column", "type").agg(
        F.max("snapshot").alias("_last")
    )
    # By now a feed has a row for each of its columns and types.
    newest = F.max("_last").over(Window.partitionBy(feed))
    current = per_type.withColumn("_newest", newest).filter(
        F.col("_last").eqNullSafe(F.col("_newest"))
    )
    nothing = F.lit(None).cast("string")
    sides = current.select(
        "feed", "column", F.col("type").alias("newest_type"),
        nothing.alias("permanent_type"), F.lit(True).alias("_new"),
        F.lit(False).alias("_old"),
    ).unionByName(
        permanent.select(
            "feed", "column", nothing.alias("newest_type"),
            F.col("type").alias("permanent_type"), F.lit(False).alias("_new"),
            F.lit(True).alias("_old"),
        )
    )
    merged = sides.groupBy(
        feed.alias("_feed"), F.lower("column").alias("_column")
    ).agg(
        F.min("feed").alias("feed"),
        F.min("column").alias("column"),
        F.max("newest_type").alias("newest_type"),
        F.max("permanent_type").alias("permanent_type"),
        F.bool_or("_new").alias("_new"),
        F.bool_or("_old").alias("_old"),
    )
    same = F.lower("newest_type").eqNullSafe(F.lower("permanent_type"))
    status = (
        F.when(~F.col("_old"), "only_newest")
        .when(~F.col("_new"), "only_permanent")
        .when(same, "identical")
        .otherwise("mismatch")
    )
    return merged.select(
        "feed", "column", "newest_type", "permanent_type", status.alias("status")
    )


def snapshot_drift(snapshots: DataFrame, permanent: DataFrame) -> DataFrame:
    """(feed, only_newest, only_permanent, mismatched, identical) per feed."""
    columns = snapshot_drift_columns(snapshots, permanent)
    status = F.col("status")
    return columns.groupBy(F.lower("feed").alias("_feed")).agg(
        F.min("feed").alias("feed"),
        F.count_if(status == "only_newest").alias("only_newest"),
        F.count_if(status == "only_permanent").alias("only_permanent"),
        F.count_if(status == "mismatch").alias("mismatched"),
        F.count_if(status == "identical").alias("identical"),
    ).drop("_feed")
