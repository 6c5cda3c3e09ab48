"""The operators, one function each."""

from plumbline.operators.activity import (
    activity_rates,
    clustering_fragmentation,
    event_flags,
    impact_ranking,
    last_access,
    member_roles,
    multi_event_entities,
    multi_event_groups,
    role_lists,
    share_of_total,
    size_report,
    top_by_cost,
)
from plumbline.operators.comparison import (
    column_diff,
    set_compare,
    set_compare_counts,
    text_version_diff,
    text_version_tokens,
)
from plumbline.operators.feeds import (
    feed_health,
    feed_inventory,
    feed_orphans,
    feed_totals,
    snapshot_drift,
    snapshot_drift_columns,
)
from plumbline.operators.profiling import (
    CheckRule,
    KeyColumn,
    check_rules,
    column_profile,
    dataset_summary,
    duplicate_groups,
    key_capacity,
    layout_candidates,
    nullable_without_nulls,
    table_schema_profile,
)
from plumbline.operators.relations import (
    Link,
    annotate_rows,
    find_references,
    grant_listing,
    latest_run,
    mention_report,
    missing_references,
    prefix_covered_lists,
    reference_candidates,
    unreferenced_rows,
)
from plumbline.operators.rows import (
    external_references,
    is_snapshot,
    keyword_guard,
    lookup_by_name,
    name_lint,
    name_lint_counts,
    object_listing,
    recent_changes,
    recent_failures,
    run_history,
    sample_rows,
    search_text,
    table_inventory,
    text_complexity,
    text_complexity_totals,
    without_snapshots,
)

__all__ = [
    "CheckRule", "KeyColumn", "Link",
    "activity_rates", "annotate_rows", "check_rules", "clustering_fragmentation",
    "column_diff", "column_profile", "dataset_summary", "duplicate_groups",
    "event_flags", "external_references", "feed_health", "feed_inventory",
    "feed_orphans", "feed_totals", "find_references", "grant_listing",
    "impact_ranking", "is_snapshot", "key_capacity", "keyword_guard", "last_access",
    "latest_run", "layout_candidates", "lookup_by_name", "member_roles", "mention_report",
    "missing_references", "multi_event_entities", "multi_event_groups", "name_lint",
    "name_lint_counts", "nullable_without_nulls", "object_listing",
    "prefix_covered_lists", "recent_changes", "recent_failures",
    "reference_candidates", "role_lists", "run_history", "sample_rows", "search_text",
    "set_compare", "set_compare_counts", "share_of_total", "size_report",
    "snapshot_drift", "snapshot_drift_columns", "table_inventory",
    "table_schema_profile", "text_complexity", "text_complexity_totals",
    "text_version_diff", "text_version_tokens", "top_by_cost", "unreferenced_rows", "without_snapshots",
]
