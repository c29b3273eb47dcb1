"""Tables kept between runs: Parquet snapshots that are replaced whole."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

CACHE_SCHEMA = "key string, sha256 string, summary string"
INDEX_SCHEMA = "ord long, text string, rel_path string, type string, name string, start_line int, end_line int, why string, embedding array<double>, sha256 string"
#: Versions that stay for readers whose plans still name them.
VERSIONS = 3


class Snapshot:
    """A table in `folder`, on any file system that Spark reads. Each write is a new version in a folder of its own, whose name counts
    upwards; a version is there once Spark has marked its job as a success, so readers see one whole version or another, and a plan
    may read the table that it replaces. The last VERSIONS stay."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder.rstrip("/"), *names]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        """Names of the whole versions, the oldest first."""
        files = self._files()
        if not files.exists(self._path()):
            return []
        names = sorted(s.getPath().getName() for s in files.listStatus(self._path()) if s.isDirectory())
        return [n for n in names if n.startswith("v-") and files.exists(self._path(n, "_SUCCESS"))]

    def read(self) -> DataFrame:
        """The table; empty if there is none or it can't be read."""
        if found := self.versions():
            try:
                return self.spark.read.schema(self.schema).parquet(f"{self.folder.rstrip('/')}/{found[-1]}")
            except AnalysisException:
                pass
        return self.spark.createDataFrame([], self.schema)

    def write(self, table: DataFrame) -> DataFrame:
        found = self.versions()
        number = int(found[-1].split("-")[1]) + 1 if found else 0
        table.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.folder.rstrip('/')}/v-{number:012}-{uuid.uuid4().hex}")
        for old in self.versions()[:-VERSIONS]:
            self._files().delete(self._path(old), True)
        return self.read()

    def clear(self) -> None:
        self.write(self.spark.createDataFrame([], self.schema))
