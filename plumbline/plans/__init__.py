"""Relational building blocks that several operators share."""

from plumbline.plans.containment import containment_pairs
from plumbline.plans.counts import column_counts, digest_key, is_digest, value_counts
from plumbline.plans.sequences import out_of_order_counts, prefix_fingerprints

__all__ = [
    "column_counts",
    "containment_pairs",
    "digest_key",
    "is_digest",
    "out_of_order_counts",
    "prefix_fingerprints",
    "value_counts",
]
