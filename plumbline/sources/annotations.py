"""Reader for annotation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.functions.text import contains_ignoring_case

ANNOTATION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("database", T.StringType()),
        T.StructField("objectName", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("addedAt", T.StringType()),
    ]
)

_BROKEN = "_broken"
_ENVELOPE = T.StructType(
    [
        T.StructField("constraints", T.ArrayType(ANNOTATION_SCHEMA)),
        T.StructField(_BROKEN, T.StringType()),
    ]
)


def _envelopes(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    reader = spark.read.schema(_ENVELOPE).option("multiLine", not lines)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN)
    return reader.json(path)


def unreadable_annotations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(file, record): the files, or lines, that aren't the JSON ``read_annotations`` takes."""
    found = _envelopes(spark, path, lines).select(
        F.col("_metadata.file_path").alias("file"), F.col(_BROKEN).alias("record"), "constraints"
    )
    # Spark wants a field of the records to be read along with what is broken about them.
    read = F.col("constraints").isNull() | (F.size("constraints") >= 0)
    return found.filter(F.col("record").isNotNull() & read).select("file", "record")


def read_annotations(
    spark: SparkSession, path: str, filter: str | None = None, lines: bool = False
) -> DataFrame:
    """Annotations from JSON of the form ``{"constraints": [{...}, ...]}``.

    A file is one such object, or each of its lines with ``lines=True``, which lets Spark
    split large files. What can't be read is left out; ``unreadable_annotations`` lists it.
    ``filter`` keeps entries whose database or object name contains it,
    ignoring case. A date that can't be read is null.
    """
    files = _envelopes(spark, path, lines)
    entry = F.explode("constraints").alias("entry")
    annotations = files.select(entry).select(
        F.col("entry.id").alias("id"),
        F.col("entry.database").alias("database"),
        F.col("entry.objectName").alias("object_name"),
        F.col("entry.type").alias("type"),
        F.col("entry.description").alias("description"),
        F.try_to_timestamp("entry.addedAt").alias("added_at"),
    )
    if filter is None:
        return annotations
    return annotations.filter(
        contains_ignoring_case(F.col("database"), filter)
        | contains_ignoring_case(F.col("object_name"), filter)
    )
