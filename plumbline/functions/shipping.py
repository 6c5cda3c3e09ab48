"""Giving the executors' Python workers this package."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_SENT: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Send the package as a zip, once per Spark application."""
    context = spark.sparkContext
    if _SENT.get("application") == context.applicationId:
        return
    archive = Path(tempfile.mkdtemp(prefix="plumbline-")) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(_PACKAGE.parent))
    context.addPyFile(str(archive))
    _SENT["application"] = context.applicationId
