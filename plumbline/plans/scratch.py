"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the one named by ``spark.checkpoint.dir``.

    Only a session on one machine (a ``local`` master) may leave that unset; it gets a
    temporary folder. Elsewhere executors would not see such a folder, so that raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _OWN.setdefault("base", tempfile.mkdtemp(prefix="plumbline-"))
    return f"{base.rstrip('/')}/plumbline-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written as Parquet to the shared folder and read back.

    The job runs when this is called. What follows may read the table several times and
    always finds the same rows, and a lost executor costs no earlier step.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
