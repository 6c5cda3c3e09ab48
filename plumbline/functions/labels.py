"""Display labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Run status codes and their labels.
RUN_STATUS = {
    0: "FAILED",
    1: "Succeeded",
    2: "Retry",
    3: "Cancelled",
    5: "Unknown",
}


def status_label(code: Column) -> Column:
    """Label of a run status code; an unlisted code is shown as its number."""
    label = F.lit(None).cast("string")
    for known, text in RUN_STATUS.items():
        label = F.when(code == known, text).otherwise(label)
    return F.coalesce(label, code.cast("string"))


def join_flags(separator: str, *flags: Column) -> Column:
    """The non-null flags, joined in order."""
    return F.concat_ws(separator, *flags)


def size_label(size_bytes: Column) -> Column:
    """Bytes as whole KB, or MB / GB with one decimal."""
    kb = F.floor(size_bytes / 1024).cast("long")

    def scaled(divisor: int) -> Column:
        return F.round(kb / divisor, 1).cast("decimal(20,1)").cast("string")

    return (
        F.when(kb >= 1024 * 1024, F.concat(scaled(1024 * 1024), F.lit(" GB")))
        .when(kb >= 1024, F.concat(scaled(1024), F.lit(" MB")))
        .otherwise(F.concat(kb.cast("string"), F.lit(" KB")))
    )
