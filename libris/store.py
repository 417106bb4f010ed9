"""Tables as immutable snapshots, with one pointer that says which of them count."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from libris.publish import publish
from libris.schema import TABLES


class Store:
    """A folder of any file system that Spark reaches.

    A commit writes new snapshots beside the old ones, then a pointer under the next
    number; a writer that comes second finds the number taken and fails, so readers see
    all of a commit or nothing.  A snapshot is never written over.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        at = self._path(f"{self.folder}/pointers")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _current(self) -> tuple[int, dict[str, str]]:
        numbers = self._pointers()
        if not numbers:
            return 0, {}
        line = self.spark.read.text(f"{self.folder}/pointers/{numbers[-1]}").first()
        return numbers[-1], json.loads(line[0])

    def table(self, name: str) -> DataFrame:
        """A table as of now; one that was never written is empty."""
        at = self._current()[1].get(name)
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{at}") if at else self.spark.createDataFrame([], TABLES[name])

    def commit(self, tables: Mapping[str, DataFrame]) -> int:
        """Makes new snapshots of some tables count, all at once; the commit's number."""
        number, at = self._current()
        for name, rows in tables.items():
            place = f"{name}/{number + 1}-{uuid.uuid4().hex}"
            rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in TABLES[name]]).write.parquet(f"{self.folder}/{place}")
            at[name] = place
        if not publish(self.spark, f"{self.folder}/pointers/{number + 1}", json.dumps(at)):
            raise RuntimeError("another writer committed meanwhile")
        return number + 1
