"""Column expressions and argument checks shared by the operators."""

from plumbline.functions.args import key_join, limited, named_column, require_columns
from plumbline.functions.labels import join_flags, size_label, status_label
from plumbline.functions.packed import packed_seconds, packed_timestamp
from plumbline.functions.text import clip_text, contains_ignoring_case, line_count
from plumbline.functions.times import days_between, latest, seconds_between

__all__ = [
    "clip_text",
    "contains_ignoring_case",
    "days_between",
    "join_flags",
    "key_join",
    "latest",
    "limited",
    "line_count",
    "named_column",
    "packed_seconds",
    "packed_timestamp",
    "require_columns",
    "seconds_between",
    "size_label",
    "status_label",
]
