"""Versions of a table: data folders beside each other and numbered commit files that say which one counts.

A version is written whole before its commit file appears under its final name, so a reader sees the old version or the new one, never a
part. The commit file is renamed without overwriting: of two writers that start from one version the second is refused. A writer that
dies leaves at most a folder that no commit names. The shared folder must rename atomically, as HDFS and local disks do.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ShortLoad(ValueError):
    """A load with fewer rows than asked for; the old version stays current."""


class StaleVersion(RuntimeError):
    """Another writer has committed since this one read."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    folder: str | None = None
    rows: int = 0
    info: dict = field(default_factory=dict)


class Versions:
    """The versions below `root`; `schema` is that of every version, a StructType or its DDL text."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str):
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _files(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def current(self) -> Version:
        """The newest committed version; number 0 before the first."""
        folder, files = self._files(f"{self.root}/commits")
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        numbers = sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())
        if not numbers:
            return Version()
        path, files = self._files(f"{self.root}/commits/{numbers[-1]:012d}.json")
        source = files.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()
        return Version(numbers[-1], **json.loads(text))

    def read(self, version: Version | None = None) -> DataFrame:
        version = version or self.current()
        if version.folder is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(version.folder)

    def write(self, df: DataFrame, after: Version, info: dict | None = None, least: int = 0) -> Version:
        """Write `df` as the version after `after`. Fewer than `least` rows are refused; rows are counted while they are written."""
        folder = f"{self.root}/data/{after.number + 1:012d}-{uuid4().hex}"
        seen = Observation()
        df.select(*self.schema.fieldNames()).observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(folder)
        rows = seen.get["rows"]
        if rows < least:
            self._drop(folder)
            raise ShortLoad(f"{rows} rows, at least {least} expected")
        version = Version(after.number + 1, folder, rows, info or {})
        self._commit(version)
        return version

    def _commit(self, version: Version) -> None:
        jvm = self.spark._jvm
        final, files = self._files(f"{self.root}/commits/{version.number:012d}.json")
        waiting, _ = self._files(f"{self.root}/commits/.{uuid4().hex}.tmp")
        target = files.create(waiting, True)
        target.write(bytearray(json.dumps({"folder": version.folder, "rows": version.rows, "info": version.info}).encode()))
        target.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else files.getUri())
        no_overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(files.makeQualified(waiting), files.makeQualified(final), no_overwrite)
        except Exception as error:
            files.delete(waiting, False)
            if "FileAlreadyExists" in str(error):
                raise StaleVersion(f"version {version.number} exists") from error
            raise

    def _drop(self, folder: str) -> None:
        path, files = self._files(folder)
        files.delete(path, True)

    def forget(self, keep: int = 2) -> None:
        """Delete the data of all but the newest `keep` versions; their commits stay as a history of row counts."""
        newest = self.current().number
        folder, files = self._files(f"{self.root}/data")
        for entry in files.listStatus(folder) if files.exists(folder) else []:
            if int(entry.getPath().getName()[:12]) <= newest - keep:
                files.delete(entry.getPath(), True)
