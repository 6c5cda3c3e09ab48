"""Table and annotation readers."""

from plumbline.sources.annotations import (
    ANNOTATION_SCHEMA, read_annotations, unreadable_annotations,
)
from plumbline.sources.lookup_files import write_lookup_files
from plumbline.sources.statistics import (
    bounds_from_footers, footer_aggregate, inventory_from_footers, pushed_aggregates,
)
from plumbline.sources.tables import Dataset

__all__ = [
    "ANNOTATION_SCHEMA",
    "Dataset",
    "bounds_from_footers",
    "footer_aggregate",
    "inventory_from_footers",
    "pushed_aggregates",
    "read_annotations",
    "unreadable_annotations",
    "write_lookup_files",
]
