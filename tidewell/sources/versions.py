"""Tables that are rewritten as a whole: versions in folders of their own, and a log that names the present one.

A version is written first; then one row in the log makes it the present one. A rewrite that fails leaves no row, so
readers see the version before; who reads a version keeps it while others are written. A write may carry a note (the
number of a batch, say); a note that is in the log already is not written again, so that batches may be repeated. One
writer at a time."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    LOG = "version long, folder string, note string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> DataFrame:
        """(version, folder, note), a row a version."""
        try:
            return self.spark.read.schema(self.LOG).json(f"{self.path}/log")
        except AnalysisException:  # nothing is written yet
            return self.spark.createDataFrame([], self.LOG)

    def _row(self, version: int | None) -> tuple[int, str] | None:
        rows = self.log() if version is None else self.log().where(F.col("version") == version)
        last = rows.orderBy(F.desc("version")).select("version", "folder").limit(1).collect()
        return tuple(last[0]) if last else None

    def latest(self) -> int:
        """The present version; 0 before the first."""
        row = self._row(None)
        return row[0] if row else 0

    def has(self, note: str) -> bool:
        return not self.log().where(F.col("note") == note).isEmpty()

    def read(self, version: int | None = None) -> DataFrame:
        row = self._row(version)
        if not row:
            raise ValueError(f"no version {version or ''} of {self.path}")
        return self.spark.read.parquet(f"{self.path}/{row[1]}")

    def write(self, df: DataFrame, note: str = "") -> int:
        """The number of the new version, or of the present one if the note was written before."""
        if note and self.has(note):
            return self.latest()
        version, folder = self.latest() + 1, f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        self.spark.createDataFrame([(version, folder, note)], self.LOG).coalesce(1).write.mode("append").json(f"{self.path}/log")
        return version


def retyped(table: Versions, values: dict[str, Column], note: str = "") -> int:
    """A new version with columns of another type or content, as when a model changes; the others stay. A null literal of
    the new type empties a column."""
    now = table.read()
    return table.write(now.select(*(values[c].alias(c) if c in values else F.col(c) for c in now.columns), *(v.alias(c) for c, v in values.items() if c not in now.columns)), note)
