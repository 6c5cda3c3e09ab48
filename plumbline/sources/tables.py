"""A named set of tables under one directory."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession


class Dataset:
    """Tables stored as ``<base>/<name>.<format>``; names ignore case.

    ``tables`` names them, or maps each name to its schema. With a schema no file
    footer is read until a query runs. Any format the session can read works. A
    database table can be profiled as well: pass a ``spark.read.format("jdbc")``
    frame straight to an operator.
    """

    def __init__(
        self,
        spark: SparkSession,
        base: str,
        tables: Iterable[str] | Mapping[str, str],
        fmt: str = "parquet",
    ):
        self._spark = spark
        self._base = base.rstrip("/")
        self._fmt = fmt
        self._schemas = dict(tables) if isinstance(tables, Mapping) else {}
        self._names = {name.lower(): name for name in tables}
        self._loaded: dict[str, DataFrame] = {}

    @property
    def names(self) -> list[str]:
        return list(self._names.values())

    def table(self, name: str) -> DataFrame:
        known = self._names.get(name.lower())
        if known is None:
            raise ValueError(
                f"Unknown table '{name}'. Available: {', '.join(self.names)}"
            )
        if known not in self._loaded:
            reader = self._spark.read.format(self._fmt)
            if known in self._schemas:
                reader = reader.schema(self._schemas[known])
            path = f"{self._base}/{known}.{self._fmt}"
            self._loaded[known] = reader.load(path)
        return self._loaded[known]

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in self.names}
